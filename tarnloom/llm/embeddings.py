"""Near-duplicate vectors by Euclidean p-stable hashing of normalised vectors, confirmed by exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, run_bounds, shuffle_parts, spread_labels, stage, whole_runs
from .graph import connected_components

WIDTH = 1.0  # of a quantisation cell
BUCKET = 64  # unrelated vectors that a bucket may hold on average
BLOCK = 1024  # vectors of a bucket that are compared as one matrix


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection agrees for two vectors that far apart (Datar et al., 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections of a table, so that unrelated vectors seldom meet, and tables, so that a pair at the cosine is met with that recall."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(3, math.ceil(math.log(max(2, rows) / BUCKET) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _packed(column: pa.ChunkedArray, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column.chunk(0)), kind).reshape(*shape)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; dividing by the largest component first keeps squares finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(rows: DataFrame, width: int, tables: int, cosine: float, kind: type) -> DataFrame:
    """(a, b, n): partial degrees of class a with b null, and edges that span each task's links with n null.

    A pair counts in the first table where it meets. A task's side 0 is compared with itself, or with side 1 if there is one.
    """

    def edges(x, y):
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], ["a", "b", "n"])

    def degrees(x, n):
        return pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "task"):
            t = t.combine_chunks()
            task, ids, copies, table, side = (t.column(c).to_numpy() for c in ("task", "id", "copies", "table", "side"))
            starts, sizes = run_bounds(task)
            for s in np.unique(sizes[sizes > 1]):
                first = starts[sizes == s]
                for lo in range(0, len(first), step := max(1, 2_000_000 // int(s * max(s, width)))):
                    at = (first[lo : lo + step, None] + np.arange(s)).ravel()
                    part = t.take(pa.array(at)).combine_chunks()
                    x = _units(_packed(part.column("raw"), kind, -1, width)).reshape(-1, s, width)
                    code = _packed(part.column("codes"), np.uint32, -1, s, tables)
                    at = at.reshape(-1, s)
                    near = np.matmul(x, x.transpose(0, 2, 1)) >= cosine
                    near &= ~np.eye(s, dtype=bool)
                    two = side[at]
                    near &= (two.max(1) == 0)[:, None, None] | (two[:, :, None] != two[:, None])
                    k, i, j = np.nonzero(near)
                    if not len(k):
                        continue
                    met, here = np.zeros(len(k), bool), table[at[k, i]]
                    for c in range(tables):  # table by table, so that memory stays with the pairs of one
                        met |= (code[k, i, c] == code[k, j, c]) & (c < here)
                    near[k[met], i[met], j[met]] = False
                    n = np.where(near, copies[at][:, None, :], 0).sum(2)
                    k, i = np.nonzero(n)
                    yield degrees(ids[at[k, i]], n[k, i].astype(np.int64))
                    label = spread_labels(near | np.eye(s, dtype=bool))
                    k, i = np.nonzero(label != np.arange(s))
                    yield edges(ids[at[k, i]], ids[at[k, label[k, i]]])

    return rows.repartition(shuffle_parts(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999, seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; vectors are linked if their labels agree and their cosine is high enough.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and rows without a label or an id, are linked
    with nothing: n_links 0, component_id their own id, kept. Vectors of different length are never linked. Equal vectors
    of one label form a class, are linked with each other and are never expanded into pairs. Rows that share an id
    are one vector with several positions, whose links add up; each row that repeats a position counts as one more vector. Recall is the chance that a pair exactly at the cosine is met; closer pairs are
    met likelier. Buckets of more than BLOCK vectors are compared block by block. Tables carry float components as they
    are, other numbers as doubles; cosines are of doubles either way.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    ok = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.when(ok, F.sha2(F.concat_ws("|", F.col(label_col).cast("string"), F.array_join(F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")), ",")), 256))
    rows = stage(vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(vec_col) if single else v).alias("v"), F.col(label_col).cast("string").alias("label"), key.alias("key")), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = stage(classes, "classes")
    found = None
    for (width,) in classes.select(F.size("v")).distinct().collect():
        same = classes.filter(F.size("v") == width)
        most = same.groupBy("label").count().agg(F.max("count")).first()[0]
        k, tables = plan_tables(most, cosine, recall)

        def hashed(batches: Iterator[pa.RecordBatch], width=width, k=k, tables=tables) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(seed)
            a, b = rng.standard_normal((width, tables * k)), rng.random(tables * k) * WIDTH
            for batch in batches:
                raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cell = np.floor((_units(raw) @ a + b) / WIDTH).astype(np.int64).reshape(-1, tables, k)
                start = mix64(np.arange(1, tables + 1, dtype=np.uint64) ^ mix64(batch.column("lh").to_numpy().view(np.uint64))[:, None])
                code = start
                for j in range(k):
                    code = mix64(code ^ cell[:, :, j].view(np.uint64))
                code = code.astype(np.uint32)  # of one label and table, the same codes have the same bucket
                buckets = mix64(start ^ code).view(np.int64)
                pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                columns = [batch.column("id"), batch.column("copies"), pack(raw), pack(code), pa.array(list(buckets), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "copies", "raw", "codes", "bucket"])

        placed = stage(same.select("id", "copies", "v", F.xxhash64("label").alias("lh")).mapInArrow(hashed, "id long, copies long, raw binary, codes binary, bucket array<long>"), "hashed")
        met = placed.select("id", F.posexplode("bucket").alias("table", "b"))
        sizes = stage(met.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
        met = placed.select("id", "copies", "raw", "codes", F.posexplode("bucket").alias("table", "b")).join(sizes, "b")
        own = F.pmod(F.xxhash64("id", "b"), F.col("blocks")).cast("int")
        one = met.filter("blocks = 1").select(F.col("b").alias("task"), "id", "copies", "table", "raw", "codes", F.lit(0).alias("side"))
        many = met.filter("blocks > 1").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select(F.xxhash64("b", F.least("i", "j"), F.greatest("i", "j")).alias("task"), "id", "copies", "table", "raw", "codes", (F.col("i") > F.col("j")).cast("int").alias("side"))
        out = stage(_compare(one.union(many), width, tables, cosine, kind), "links")
        discard(placed, sizes)
        found = out if found is None else found.union(out)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    ids = rows.filter("key is not null").groupBy("vec_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y")
    bridge = rows.join(ids.select("vec_id"), "vec_id", "left_semi").filter("key is not null").join(classes.select("key", "id"), "key").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    comps = connected_components(found.filter("b is not null").select("a", "b").union(bridge))
    degree = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.select("key", "id", "copies").join(degree.withColumnRenamed("a", "id"), "id", "left").join(comps, "id", "left")
    named = stage(named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "named")
    out = rows.select("vec_id", "key").join(named, "key", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
