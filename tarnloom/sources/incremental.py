"""Totals of a growing folder: only files that no finished run has read are read, and partial results are merged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import exists

#: How each kind of partial result is made of rows, and merged.
KINDS: dict[str, tuple[Callable, Callable]] = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
FILES = "path string, length bigint, modificationTime timestamp"


def _finished(spark: SparkSession, state: str, what: str) -> list[str]:
    """Folders of runs that came to their end. A run writes its files last, so one that broke off has no list of them."""
    if not exists(spark, state):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    runs = sorted(f.getPath().toString() for f in listed if f.getPath().getName().startswith("run-"))
    return [f"{r}/{what}" for r in runs if exists(spark, f"{r}/files/_SUCCESS")]


def processed_files(spark: SparkSession, state: str) -> DataFrame:
    """(path, length, modificationTime) of the files that finished runs have read."""
    runs = _finished(spark, state, "files")
    return spark.read.schema(FILES).parquet(*runs) if runs else spark.createDataFrame([], FILES)


def update_totals(
    spark: SparkSession, folder: str, state: str, read: Callable[[list[str]], DataFrame], by: list[str], values: dict[str, tuple[str, Column]], pattern: str = "*",
) -> DataFrame:
    """by and values, over all files of the folder; a call reads only files that are new since the last one.

    values maps names to (kind, column): count, sum, min or max, which merge; the latest row of a group is a max of a struct
    that begins with what orders it. read gives the rows of some paths. The state folder holds, for each run, its partial
    result and then the list of its files, so a run that breaks off is as if it had not begun. A file whose length or
    time changed since it was read is an error: what it gave can't be taken out again. Paths of new files go through the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    known = processed_files(spark, state).select(F.col("path"), F.col("length").alias("_length"), F.col("modificationTime").alias("_time"))
    met = files.join(known, "path", "left")
    changed = met.filter((F.col("_length") != F.col("length")) | (F.col("_time") != F.col("modificationTime"))).select("path").limit(1).collect()
    if changed:
        raise ValueError(f"{changed[0]['path']} has changed since it was read")
    new = met.filter("_length is null").select("path", "length", "modificationTime").collect()
    if new:
        run = f"{state.rstrip('/')}/run-{len(_finished(spark, state, 'files')):08d}-{uuid.uuid4().hex[:8]}"
        rows = read([r["path"] for r in new])
        rows.groupBy(*by).agg(*[KINDS[kind][0](c).alias(n) for n, (kind, c) in values.items()]).write.parquet(f"{run}/totals")
        spark.createDataFrame(new, FILES).write.parquet(f"{run}/files")
    runs = _finished(spark, state, "totals")
    if not runs:
        raise ValueError(f"no files in {folder}")
    return spark.read.parquet(*runs).groupBy(*by).agg(*[KINDS[kind][1](n).alias(n) for n, (kind, _) in values.items()])
