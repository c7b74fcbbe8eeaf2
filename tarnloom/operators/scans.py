"""Running sums and maxima within groups, whatever a group's size.

Small groups go through a window, a group a task. A group of more rows is divided: the rows are sorted in ranges of the groups
and the order, each range gives one total a group, and a running value is the range's own plus what the ranges before it give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

MOST = 1 << 20  # rows of a group that one task puts in order


def same(df: DataFrame, other: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """other with its columns `by` renamed, and the condition that they equal those of df; nulls are equal."""
    other = other.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(by)})
    condition = F.lit(True)
    for k, c in enumerate(by):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return other, condition


def in_sizes(df: DataFrame, by: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most `most` rows, and those of larger groups (None if there are none). df is read to tell."""
    most = MOST if most is None else most
    if df.count() <= most:
        return df, None
    large = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*by)
    if large.isEmpty():
        return df, None
    other, condition = same(df, large, by)
    return df.join(other, condition, "left_anti"), df.join(other, condition, "left_semi")


def running(rows: DataFrame, by: list[str], order: Column, name: str, value: str, how: Callable, itself: bool = True) -> DataFrame:
    """rows with `name`: F.sum or F.max of value over the rows up to each in its group; without `itself`, those before it."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return rows.withColumn(name, how(value).over(window))


def running_in_ranges(rows: DataFrame, by: list[str], order: Column, name: str, value: str, how: Callable, itself: bool = True) -> DataFrame:
    """The same for groups of any size. The order must be total within a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in by], order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_p").agg(how(value).alias("_total"))  # one row for each range of a group
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals, condition = same(ranged, totals.withColumn("_before", how("_total").over(before)).withColumnRenamed("_p", "_of"), by)
    out = running(ranged, [*by, "_p"], order, name, value, how, itself)
    out = out.join(totals, condition & (F.col("_p") == F.col("_of")))
    both = F.coalesce(name, F.lit(0)) + F.coalesce("_before", F.lit(0)) if how is F.sum else F.greatest(name, "_before")
    return out.withColumn(name, both).select(*rows.columns, name)
