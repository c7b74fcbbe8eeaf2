"""Unions, differences and seeded samples. Orders come from md5, so SQL elsewhere can give the same sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def seeded(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for a seed; all rows if there are fewer."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def bootstrap(df: DataFrame, position: str, width: int, replicates: int, seed: int = 42) -> DataFrame:
    """Columns resampled with replacement: (replicate, slot, rows of df at the drawn position), positions from 1, in order of the draw."""
    slots = df.sparkSession.range(1, replicates + 1).select(F.col("id").alias("replicate")).select("replicate", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("slot"))
    draw = F.pmod(F.conv(F.substring(seeded(seed, "replicate", "slot"), 1, 8), 16, 10).cast("bigint"), F.lit(width)) + 1
    return slots.withColumn(position, draw.cast("int")).join(df, position)
