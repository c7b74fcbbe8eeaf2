"""Aggregates of scores and symbols. Everything is combined before the shuffle; no group is gathered in a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import in_sizes, running, running_in_ranges, same


def _places(df: DataFrame, by: list[str], score: str, most: int | None) -> DataFrame:
    """(by, _s, _c, _upto, _n): distinct scores, how often each occurs, the count up to it and the group's; nulls first, count 0.

    Equal scores are counted first. Groups of more than `most` rows are put in order by ranges of their scores, so no task
    sees all distinct scores of a hot group.
    """
    parts, each = in_sizes(df, by, most), []
    for part, run in zip(parts, (running, running_in_ranges), strict=True):
        if part is not None:
            counts = part.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count(score).alias("_c"))
            each.append(run(counts, by, F.asc_nulls_first("_s"), "_upto", "_c", F.sum))
    places = each[0] if len(each) == 1 else each[0].union(each[1])
    if len(each) == 1:
        return places.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    groups, condition = same(places, df.groupBy(*by).agg(F.count(score).alias("_n")), by)
    return places.join(groups, condition).select(*by, "_s", "_c", "_upto", "_n")


def tail_means(df: DataFrame, by: list[str], score: str, etas: dict[str, float], clip: bool = True, most: int | None = None) -> DataFrame:
    """For each group and name in etas, the mean of its max(1, floor(eta * n)) lowest scores. Null scores don't count."""
    ranked = _places(df.filter(F.col(score).isNotNull()), by, score, most)
    out = []
    for name, eta in etas.items():
        eta = min(1.0, max(1e-6, eta)) if clip else eta
        k = F.greatest(F.lit(1), F.floor(F.lit(float(eta)) * F.col("_n")))
        taken = F.greatest(F.lit(0), F.least(F.col("_c"), k - (F.col("_upto") - F.col("_c"))))
        out.append((F.sum(taken * F.col("_s")) / F.max(k)).alias(name))
    return ranked.groupBy(*by).agg(*out)


def evaluate(df: DataFrame, item: str, score: str, eta: float = 0.1, tau: float | None = None) -> DataFrame:
    """n, mean, min, max, retention (share of scores >= tau; NaN without tau) and robust (lower-tail mean) of each item."""
    kept = F.avg(F.when(F.col(score) >= tau, 1.0).when(F.col(score).isNotNull(), 0.0)) if tau is not None else F.lit(float("nan"))
    base = df.groupBy(item).agg(F.count(score).alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), kept.alias("retention"))
    return base.join(tail_means(df, [item], score, {"robust_score": eta}), item, "left")


def roll_up(df: DataFrame, group: str, columns: list[str], baseline: str | None = None, tau: float = 7.5) -> DataFrame:
    """n and null-skipping means of each group, and the share of rows whose baseline is at least tau."""
    share = [F.avg(F.when(F.coalesce(F.col(baseline), F.lit(0.0)) >= tau, 1.0).otherwise(0.0)).alias("share")] if baseline else []
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns], *share)


def mean_of_means(df: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    return df.groupBy(outer, inner).agg(F.avg(score).alias("m")).groupBy(outer).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("parts"))


def summary(df: DataFrame, group: str, score: str, most: int | None = None) -> DataFrame:
    """n, mean, exact median, min and max of each group; n counts scores that aren't null.

    The median is where the running count of distinct scores passes the middle.
    """
    ranked = _places(df, [group], score, most)
    at = lambda place: F.min(F.when((F.col("_c") > 0) & (F.col("_upto") >= place), F.col("_s")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    total = F.sum(F.col("_c") * F.col("_s"))
    mean = F.when(F.max("_n") > 0, total / F.max("_n"))
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), mean.alias("mean"), ((at(low) + at(high)) / 2).alias("median"), F.min("_s").alias("min"), F.max("_s").alias("max"))


def shares(df: DataFrame, group: str, score: str, cuts: dict[str, float]) -> DataFrame:
    """Rows above each cut, and their share."""
    out = []
    for name, cut in cuts.items():
        out += [F.count_if(F.col(score) > cut).alias(f"n_{name}"), F.avg((F.coalesce(F.col(score) > cut, F.lit(False))).cast("int")).alias(f"share_{name}")]
    return df.groupBy(group).agg(*out)


def weighted_mean(df: DataFrame, by: str, score: str, weight: str) -> DataFrame:
    """Mean by weights normalised over the group; equal weights where they add up to 0."""
    w, s = F.coalesce(F.col(weight), F.lit(0.0)), F.col(score)
    total = F.sum(F.when(s.isNotNull(), w))
    return df.groupBy(by).agg(F.when(total > 0, F.sum(w * s) / F.greatest(total, F.lit(1e-12))).otherwise(F.avg(s)).alias("weighted_mean"))


def latest(df: DataFrame, tag: Column, stem: str, values: list[str]) -> DataFrame:
    """The row with the largest stem of each tag."""
    return df.groupBy(tag.alias("tag")).agg(F.max(F.struct(stem, *values)).alias("_r")).select("tag", *[F.col(f"_r.{c}").alias(c) for c in (stem, *values)])


def best(df: DataFrame, by: str, score: str, ordinal: str, values: list[str]) -> DataFrame:
    """The row with the largest score of each key; of several the first by ordinal. Null scores lose."""
    order = F.struct(F.col(score), -F.col(ordinal))
    return df.groupBy(by).agg(F.max_by(F.struct(score, ordinal, *values), order).alias("_r")).select(by, *[F.col(f"_r.{c}").alias(c) for c in (score, ordinal, *values)])


def symbol_counts(df: DataFrame, by: list[str], body: str, ordinal: str) -> DataFrame:
    """(by, pos, symbol, n, first): counts of each character by position, from 0; first is the least ordinal that has it."""
    chars = df.filter(F.length(body) > 0).select(*by, ordinal, F.posexplode(F.split(F.col(body), "")).alias("pos", "symbol"))
    return chars.groupBy(*by, "pos", "symbol").agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))


def consensus(df: DataFrame, by: list[str], body: str, ordinal: str, ignore: str = "-", pad: str = "-", none: str = "-", ties: str = "first") -> DataFrame:
    """The most frequent character at each position, joined to one string for each group.

    Shorter rows count as `pad` behind their end. Characters in `ignore` never win; where nothing else stands, `none` does.
    Ties go to the character seen first (ties="first") or in order of the alphabet. Other variants are settings:
    ignore="" lets gaps win; ignore="-X*." with none="X"; ignore all off an alphabet with none="A" and ties="symbol".
    """
    seen = symbol_counts(df, by, body, ordinal)
    size = df.groupBy(*by).agg(F.count("*").alias("rows"), F.max(F.length(body)).alias("width"))
    filled = seen.groupBy(*by, "pos").agg(F.sum("n").alias("filled"))
    short = filled.join(size, by).filter("filled < rows").select(*by, "pos", F.lit(pad).alias("symbol"), (F.col("rows") - F.col("filled")).alias("n"), F.lit(None).cast("bigint").alias("first"))
    every = seen.union(short).groupBy(*by, "pos", "symbol").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    if ignore:
        every = every.withColumn("n", F.when(F.instr(F.lit(ignore), F.col("symbol")) > 0, 0).otherwise(F.col("n")))
    tie = F.coalesce(-F.col("first"), F.lit(-(1 << 62))) if ties == "first" else -F.ascii("symbol").cast("bigint")
    top = every.groupBy(*by, "pos").agg(F.max(F.struct(F.col("n"), tie.alias("t"), "symbol")).alias("r"))
    char = F.when(F.col("r.n") > 0, F.col("r.symbol")).otherwise(none)
    # Positions of a group are as many as its longest row, so its string is about as long as one row.
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))), lambda x: x["c"]), "").alias("consensus"))


def diversity(df: DataFrame, by: list[str], symbol: str, kinds: int = 20) -> DataFrame:
    """1 - H / ln(kinds), H the Shannon entropy of the symbols with 1e-9 added inside the logarithm; 0 for no rows."""
    n = df.filter(F.col(symbol).isNotNull()).groupBy(*by, symbol).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.join(total, by).groupBy(*by).agg((1 + F.sum(p * F.log(p + 1e-9)) / F.log(F.lit(float(kinds)))).alias("conservation"))


def modal_length(df: DataFrame, body: str) -> DataFrame:
    """(width): the most frequent length above 0; ties go to the smallest. One row, or none."""
    n = df.filter(F.length(body) > 0).groupBy(F.length(body).alias("width")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "width").limit(1).select("width")


def to_modal_length(df: DataFrame, body: str) -> DataFrame:
    """Upper case, cut or padded with gaps to the modal length; empty bodies are dropped."""
    width = F.broadcast(modal_length(df, body))
    return df.filter(F.length(body) > 0).crossJoin(width).withColumn(body, F.rpad(F.upper(F.substring(F.col(body), F.lit(1), F.col("width"))), F.col("width"), F.lit("-"))).drop("width")


def reference_point(df: DataFrame, group: str, excluded: str, axes: list[str]) -> DataFrame:
    """The least value of each axis over all groups but one. One row."""
    return df.filter(F.col(group) != excluded).agg(*[F.min(a).alias(f"ref_{a}") for a in axes])


def improved(df: DataFrame, group: str, score: str, first: str, second: str) -> DataFrame:
    """Whether the mean of the first group is above that of the second. One row."""
    m = [F.avg(F.when(F.col(group) == g, F.col(score))) for g in (first, second)]
    return df.agg(m[0].alias("mean_first"), m[1].alias("mean_second"), (m[0] > m[1]).alias("improved"))
