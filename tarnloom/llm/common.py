"""What the operators share: fold rule, staged tables, Arrow batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold rule: crc32 of the id as text is a multiple of 5. A null id is held out, so nothing is learned from it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it is deleted when the driver's Python ends.

    Where that setting is unset, a folder set on the context serves, then, on a local master only, a temporary one.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _OWN:
        root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if root:
            _OWN[app] = f"{root.rstrip('/')}/tarnloom-{app}"
            atexit.register(_clear, spark, _OWN[app])
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="tarnloom-")
            _OWN[app] = f"file://{own}"
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear(spark: SparkSession, path: str) -> None:
    """Delete what this application has staged; nothing where its context has stopped already."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


ROWS_A_FILE = 250_000


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df in the shared folder and read it back; with a bound on its narrow rows, in no more files than they need.

    This cuts lineage in a way that survives lost executors. Both sides of a later join are then
    plain scans, so adaptive execution can split a hot key.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case and every other character as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def hash_sample(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` rows, those with the smallest hashes of the id (then smallest ids), in that order.

    A cut on the hash first leaves little more than the wanted rows, so the final sort stays small on any input.
    """
    h = F.xxhash64(id_col)
    n = rows.count()
    if n > most:
        share = most / n + 8 * (most**0.5 + 8) / n
        if share < 1:
            rows = rows.filter(h <= F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(h, id_col).limit(most)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without a copy, and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def characters(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20, carry: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, bool]]:
    """Code points of a text column piece by piece: (first row, bounds of its rows, points, points carried over, row ends here).

    Rows of about `size` bytes come at once. A longer row comes alone and in parts, cut between characters; each part but the
    first begins with the last `carry` points of the one before. Ill-formed bytes read as U+FFFD.
    """

    def points_of(raw: np.ndarray) -> np.ndarray:
        return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        raw = data[offsets[lo] : offsets[hi]]
        if hi - lo > 1 or len(raw) <= size:
            points = points_of(raw)
            bounds = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets[lo : hi + 1] - offsets[lo]]
            if bounds[-1] != len(points):
                own = [points_of(data[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                points, bounds = np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])]
            yield lo, bounds, points, 0, True
        else:
            cut, kept = 0, np.zeros(0, np.uint32)
            while cut < len(raw):
                end = min(cut + size, len(raw))
                while cut + 1 < end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                points = np.r_[kept, points_of(raw[cut:end])]
                yield lo, np.array([0, len(points)]), points, len(kept), end == len(raw)
                cut, kept = end, points[max(0, len(points) - carry) :]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a stream sorted by key so that no key is divided between two tables."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if kept and (cut or kept[-1].column(key)[-1].as_py() != keys[0]):
            if kept[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(kept)
                kept = []
            if cut:
                yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
                kept = [batch.slice(cut)]
            else:
                kept.append(batch)
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def spread_labels(near: np.ndarray) -> np.ndarray:
    """Smallest reachable position for every member of k graphs of s members each: near is (k, s, s), symmetric, with a true diagonal."""
    k, s, _ = near.shape
    label = np.broadcast_to(np.arange(s, dtype=np.int32), (k, s)).copy()
    while True:
        nxt = np.where(near, label[:, None, :], s).min(2)
        nxt = np.take_along_axis(nxt, nxt, 1)
        if (nxt == label).all():
            return label
        label = nxt
