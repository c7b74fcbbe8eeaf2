"""Tables of a data folder, and written intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when the driver's Python ends.

    Where that is unset, a folder set on the context serves, then, on a local master only, a temporary one.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _OWN:
        root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if root:
            _OWN[app] = f"{root.rstrip('/')}/tarnloom-base-{app}"
            atexit.register(_clear, spark, _OWN[app])
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="tarnloom-base-")
            _OWN[app] = f"file://{own}"
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN[app]


def _clear(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: lineage is cut in a way that survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
