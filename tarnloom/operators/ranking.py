"""Ranks, top rows, first occurrences, Pareto fronts and hypervolume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .scans import in_sizes, running, running_in_ranges


def number_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1..n over the whole table in that order, which should be total.

    Rows are sorted in ranges; only one count for each range goes to every task, so no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row for each range
    before = counts.select(F.col("_p"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", place).join(F.broadcast(before), "_p").select(*cols, (F.col("_r") + F.col("_before")).alias(name))


def joined_back(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of groups, one row for each value of `by`; null keys are values like others."""
    renamed = groups.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(by)})
    same = [df[c].eqNullSafe(renamed[f"_by{k}"]) for k, c in enumerate(by)]
    return df.join(renamed, same, "left").drop(*[f"_by{k}" for k in range(len(by))])


def number_within(df: DataFrame, by: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """1..n within each group in that order, and the group's n.

    The whole table is numbered in ranges of the groups and the order, so a hot group is divided between tasks; a group's
    first number is taken off.
    """
    numbered = number_rows(df, [*[F.asc_nulls_first(c) for c in by], *order], "_place")
    groups = numbered.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias(size))
    out = joined_back(numbered, groups, by)
    return out.withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def rank_descending(df: DataFrame, score: str, ordinal: str, by: list[str] | None = None) -> DataFrame:
    """Ranks 1..n by falling score, missing ones last, ties in input order; within groups if `by` is given."""
    order = [F.desc_nulls_last(score), F.asc(ordinal)]
    return number_within(df, by, order, "rank", "_n").drop("_n") if by else number_rows(df, order)


def rank_normalised(df: DataFrame, by: list[str], score: str, ordinal: str) -> DataFrame:
    """(rank - 1) / (n - 1) by rising score with ties in input order; 0.5 for a group of one."""
    ranked = number_within(df, by, [F.asc_nulls_first(score), F.asc(ordinal)], "_r", "_n")
    share = F.when(F.col("_n") == 1, 0.5).otherwise((F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.withColumn("rank_norm", share).drop("_r", "_n")


def top_after_filter(df: DataFrame, score: str, threshold: float, n: int, ties: list[str], ascending: bool = False) -> DataFrame:
    """The best n rows at or above a threshold; a missing score counts as 0."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    return df.filter(value >= threshold).orderBy(value.asc() if ascending else value.desc(), *ties).limit(n)


def head(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows in load order."""
    if n <= 0:
        raise ValueError("limit must be positive")
    return df.orderBy(ordinal).limit(n)


def first_occurrences(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the least ordinal of each key. A minimum is kept per key, so equal keys are never gathered.

    Text keys are grouped by their SHA-256, so that long texts aren't compared, and moved once.
    """
    hashed = [F.sha2(c, 256) if dict(df.dtypes)[c] == "string" else F.col(c) for c in keys]
    first = df.groupBy(*[h.alias(f"_k{k}") for k, h in enumerate(hashed)]).agg(F.min_by(F.struct(*df.columns), F.col(ordinal)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def upper_median_size(df: DataFrame, size: str) -> DataFrame:
    """(size): of the distinct sizes in order, the one at n // 2."""
    distinct = df.select(size).distinct()
    return distinct.agg(F.array_sort(F.collect_set(size)).alias("s")).select(F.get("s", (F.size("s") / 2).cast("int")).alias(size))


def _tops(points: DataFrame, by: list[str], x: str, y: str, most: int | None) -> DataFrame:
    """(by, x, _top, _above): the best y of each x, and the best y of all larger x.

    Groups of more than `most` points are divided into ranges of x; each passes the best y of the ranges above it on.
    """
    each = []
    for part, run in zip(in_sizes(points, by, most), (running, running_in_ranges), strict=True):
        if part is not None:
            each.append(run(part.groupBy(*by, x).agg(F.max(y).alias("_top")), by, F.desc(x), "_above", "_top", F.max, itself=False))
    return each[0] if len(each) == 1 else each[0].union(each[1])


def pareto_front(df: DataFrame, by: list[str], x: str, y: str, most: int | None = None) -> DataFrame:
    """The rows that no row of their group equals or beats on both axes and beats on one; duplicates stay.

    A point stays if its y is the best of its x and above the best y of every larger x. Rows with a null axis are left out.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    tops = _tops(points, by, x, y, most)
    front = tops.filter(F.col("_above").isNull() | (F.col("_top") > F.col("_above")))
    return points.join(front.select(*by, x, "_top"), [*by, x]).filter(F.col(y) == F.col("_top")).select(df.columns)


def hypervolume(df: DataFrame, by: list[str], x: str, y: str, reference: tuple[float, float] | None = None, most: int | None = None) -> DataFrame:
    """Area that each group's front dominates above the reference point, by default the group's least value of each axis."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ref = [F.lit(float(r)) for r in reference] if reference else [F.min(x), F.min(y)]
    refs = points.groupBy(*by).agg(ref[0].alias("_rx"), ref[1].alias("_ry"))
    tops = _tops(points, by, x, y, most).join(refs, by)
    step = F.greatest(F.lit(0.0), F.col(x) - F.col("_rx")) * F.greatest(F.lit(0.0), F.col("_top") - F.greatest(F.coalesce("_above", "_ry"), F.col("_ry")))
    return tops.groupBy(*by).agg(F.sum(step).alias("hypervolume"))


def normalised_weights(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Weights over max(sum, 1e-12) of their group; equal ones where the group has none."""
    groups = df.groupBy(*by).agg(F.count(weight).alias("_given"), F.sum(weight).alias("_total"), F.count("*").alias("_n"))
    share = F.coalesce(F.col(weight), F.lit(0.0)) / F.greatest(F.col("_total"), F.lit(1e-12))
    norm = F.when(F.col("_given") == 0, 1.0 / F.col("_n")).otherwise(share)
    return joined_back(df, groups, by).withColumn("weight_norm", norm).drop("_given", "_total", "_n")
