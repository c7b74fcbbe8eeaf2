"""Whole workflows: evaluating items, splitting records, summarising runs, and parameter sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_id, ungapped
from ..operators import aggregates, filters, ranking, sampling
from ..storage import stage


def evaluate_and_rank(scores: DataFrame, item: str, score: str, eta: float = 0.1, tau: float | None = None) -> DataFrame:
    """Each item's n, mean, min, robust score and retention, ranked by robust score; ties by item."""
    return ranking.number_rows(aggregates.evaluate(scores, item, score, eta, tau), [F.desc_nulls_last("robust_score"), F.asc(item)])


def clean_records(records: DataFrame, low: int, high: int, ordinal: str = "ordinal", n: int | None = None, least: int = 20, seed: int = 42, as_given: bool = False) -> DataFrame:
    """Cleaned ids and bodies of bounded length, first occurrences of a body, a seeded sample; ValueError for too few.

    The bounds hold for the cleaned body, or with as_given for the body as it came, with gaps and before its letters' upper case.
    """
    bounded, cleaned = filters.length_between("body", low, high), {"id": clean_id("id"), "body": ungapped("body")}
    rows = records.filter(bounded).withColumns(cleaned) if as_given else records.withColumns(cleaned).filter(bounded)
    rows = ranking.first_occurrences(rows, ["body"], ordinal)
    return filters.at_least_rows(sampling.sample(rows, "id", n, seed) if n else rows, least)


def summarise_runs(runs: DataFrame, tag: str, method: str, x: str, y: str) -> DataFrame:
    """For each tag n and means, and the size and hypervolume of its front above the least value of each axis over all tags."""
    low = runs.agg(F.min(x).alias("_rx"), F.min(y).alias("_ry")).first()  # one row
    front = ranking.pareto_front(runs, [tag], x, y)
    volume = ranking.hypervolume(runs, [tag], x, y, (low["_rx"], low["_ry"])) if low["_rx"] is not None else runs.select(tag).distinct().withColumn("hypervolume", F.lit(None).cast("double"))
    rolled = aggregates.roll_up(runs, tag, [x, y])
    return rolled.join(front.groupBy(tag).agg(F.count("*").alias("front")), tag, "left").join(volume, tag, "left")


def score_pairs(pairs: DataFrame, item: str, scenario: str, scorer: Callable[[pd.Series, pd.Series], pd.Series], batch: int = 64) -> DataFrame:
    """pairs with `score` from a pluggable scorer, called on batches; if a batch fails, its rows are scored one by one."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            out = []
            for at in range(0, len(a), batch):
                x, y = a.iloc[at : at + batch], b.iloc[at : at + batch]
                try:
                    out.append(pd.Series(scorer(x, y)).astype("float64"))
                except Exception:  # the documented fallback of a batched scorer
                    out.append(pd.Series([float(pd.Series(scorer(x.iloc[[k]], y.iloc[[k]])).iloc[0]) for k in range(len(x))]))
            yield pd.concat(out, ignore_index=True) if out else pd.Series([], dtype="float64")

    return pairs.withColumn("score", F.pandas_udf(run, "double")(item, scenario))


def timing_probe(pairs: DataFrame, item: str, scenario: str, scorer: Callable[[pd.Series, pd.Series], pd.Series], batches: tuple[int, ...] = (1, 50), n: int = 50, rounds: int = 5) -> DataFrame:
    """(batch, rows, seconds, pairs_a_second) of scoring the same n pairs in batches of each size, the best of `rounds` in a task.

    What score_pairs should be given as `batch` follows from it. The n pairs, the first by item and scenario, go to each task.
    """
    probe = pairs.select(F.col(item).alias("a"), F.col(scenario).alias("b")).orderBy("a", "b").limit(n).toPandas()  # n rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sizes in parts:
            for batch in sizes["batch"]:
                best = float("inf")
                for _ in range(rounds):
                    start = time.perf_counter()
                    for at in range(0, len(probe), batch):
                        scorer(probe["a"].iloc[at : at + batch], probe["b"].iloc[at : at + batch])
                    best = min(best, time.perf_counter() - start)
                yield pd.DataFrame({"batch": [batch], "rows": [len(probe)], "seconds": [best], "pairs_a_second": [len(probe) / max(best, 1e-9)]})

    sizes = pairs.sparkSession.createDataFrame([(b,) for b in batches], "batch int").repartition(1)  # one after another
    return sizes.mapInPandas(run, "batch int, rows long, seconds double, pairs_a_second double")


def score_distinct(pairs: DataFrame, item: str, scenario: str, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """As score_pairs, with each distinct pair scored once."""
    return pairs.join(score_pairs(pairs.select(item, scenario).distinct(), item, scenario, scorer), [item, scenario])


def eta_sweep(scores: DataFrame, item: str, score: str, etas: list[float]) -> DataFrame:
    """(eta, n, mean, median, min, max) of the items' lower-tail means at each eta; the items' means are made once."""
    tails = stage(aggregates.tail_means(scores, [item], score, {f"e{k}": e for k, e in enumerate(etas)}), "tails")
    long = tails.select(F.explode(F.array(*[F.struct(F.lit(float(e)).alias("eta"), F.col(f"e{k}").alias("tail")) for k, e in enumerate(etas)])).alias("r")).select("r.*")
    return aggregates.summary(long, "eta", "tail")


def ablations(base: dict, variants: dict[str, dict], run: Callable[[dict], DataFrame]) -> DataFrame:
    """The results of run for each variant's settings over the base ones, with the variant's name as run_tag."""
    return sampling.union_all([run({**base, **v}).withColumn("run_tag", F.lit(k)) for k, v in variants.items()])


def sensitivity(base: dict, values: dict[str, list], run: Callable[[dict], DataFrame]) -> DataFrame:
    """One setting at a time: run for each value of each list, with parameter and value columns."""
    return sampling.union_all([run({**base, k: v}).withColumns({"parameter": F.lit(k), "value": F.lit(str(v))}) for k, vs in values.items() for v in vs])


def shuffled(items: DataFrame, body: str, seed: int = 42) -> DataFrame:
    """A control: each body's characters in a seeded random order."""
    order = F.array_sort(F.transform(F.split(F.col(body), ""), lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(body), i.cast("string"))).alias("k"), c.alias("c"))))
    return items.withColumn("control", F.array_join(F.transform(order, lambda s: s["c"]), ""))
