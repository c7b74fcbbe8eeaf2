"""Connected components of an edge table by alternating large-star and small-star passes (Kiveris et al., 2014).

Each pass takes a minimum per vertex, which is combined before the shuffle, and joins it back; nothing is gathered per
vertex. Minima are cached, so a join's sides are plain scans and a hub's rows can be split between tasks. Each round
ends in a written table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stage


def _round(e: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least2 = large.groupBy("u").agg(F.min("v").alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v")))
    return small.distinct(), [least, least2]


def _written(e: DataFrame, rows: int | None) -> tuple[DataFrame, tuple[int, int]]:
    """Stage e; its row count and the sum of its row hashes come from the same job."""
    seen = Observation()
    out = stage(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc", rows)
    got = seen.get
    return out, (got["n"], int(got["h"] or 0))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs to (id, component): the smallest id reachable, one row for each id in an edge.

    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, state = _written(e, None)
    while state[0]:
        nxt, cached = _round(e)
        small, now = _written(nxt, state[0])
        for c in cached:
            c.unpersist()
        discard(e)
        e, before, state = small, state, now
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
