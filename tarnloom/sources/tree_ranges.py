"""Edges of one huge tree file, read by as many tasks as it has splits.

A file is read as pieces between commas, each of which opens a node. A first pass counts, for each split, the nodes it opens
and the brackets it leaves open; carried over the splits that gives each split's first node number and depth. A second pass
reads the splits on their own. Where a node's parent, or the node that a closing bracket names, was opened by an earlier
split, its level stands in for it: it is what the last split before left open at that level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage
from .text_records import with_ordinal

TOKEN = re.compile(r"([(),;])|:([^,();\[]*)|'([^']*)'|\[[^\]]*\]|([^\s:,();\['][^:,();\[]*)|\s+|('|\[)", re.S)
COUNTS = "source_file string, at long, nodes long, depth long, state string"
#: A node (number), a label of a node that an earlier split opened (level alone), or what a split leaves open (kind `open`).
ROWS = "source_file string, at long, kind string, number long, parent long, level long, name string, length double"


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    return with_ordinal(spark.read.option("lineSep", ",").text(paths)).select("source_file", F.col("ordinal.at").alias("at"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, at, value in zip(*(batch.column(c).to_pylist() for c in ("source_file", "at", "value")), strict=True):
            yield (file, at), value


class _Reader:
    """Reads the pieces of one split. Numbers and depth are as given for its start; levels count from the root's children as 0."""

    def __init__(self, key: tuple[str, int], number: int, depth: int):
        self.key, self.number, self.depth, self.path = key, number, depth, []
        self.outer, self.buffer, self.ended, self.rows = depth, None, False, []
        self.here: list | None = None

    def parent(self) -> tuple[int | None, int | None]:
        return (self.path[-1], None) if self.path else (None, self.outer - 1 if self.outer else None)

    def opened(self) -> None:
        number, level = self.parent()
        self.here = [*self.key, "node", self.number, number, level, "", None]
        self.rows.append(self.here)
        self.number += 1

    def read(self, value: str) -> None:
        if self.ended:
            return
        text = value if self.buffer is None else f"{self.buffer},{value}"
        tokens = list(TOKEN.finditer(text))
        if any(m.group(5) for m in tokens):  # a quote or comment goes on behind the comma
            self.buffer = text
            return
        self.buffer = None
        self.opened()
        for m in tokens:
            mark, length, quoted, label, _ = m.groups()
            if mark == "(":
                self.path.append(self.here[3])
                self.depth += 1
                self.opened()
            elif mark == ")":
                self.depth -= 1
                if self.path:
                    at = self.path.pop()
                    self.here = [*self.key, "label", at, None, None, None, None]
                else:
                    self.outer -= 1
                    self.here = [*self.key, "label", None, None, self.outer, None, None]
                self.rows.append(self.here)
            elif mark == ";":
                self.ended = True
                return
            elif length is not None:
                self.here[7] = float(length)
            elif quoted is not None or label is not None:
                self.here[6] = quoted if quoted is not None else label.strip()

    def end(self) -> list[list]:
        return self.rows + [[*self.key, "open", n, None, self.outer + k, None, None] for k, n in enumerate(self.path)]


def scan_large_trees(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(tree_id, node, parent, name, length) of one tree a file, as parse_newick numbers its nodes.

    ValueError where brackets don't match, or where a comma within a quoted label or a comment lies at the end of a split. The
    driver holds a row a split.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], _Reader] = {}
        for key, value in _splits(batches):
            reader = held.setdefault(key, _Reader(key, 0, 0))
            reader.read(value)
            reader.rows = []
        rows = [(*k, r.number, r.depth, "ended" if r.ended else "open" if r.buffer is not None else "") for k, r in held.items()]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in COUNTS.split(", ")])

    starts: dict[tuple[str, int], tuple[int, int]] = {}
    file, number, depth, over = None, 0, 0, False
    for r in sorted(_pieces(spark, paths).mapInArrow(count, COUNTS).collect()):
        if r["source_file"] != file:
            if depth:
                raise ValueError(f"unbalanced tree in {file}")
            file, number, depth, over = r["source_file"], 0, 0, False
        if r["state"] == "open" and not over:
            raise ValueError(f"a quoted label or comment of {file} goes on behind the split at byte {r['at']}")
        if not over:
            starts[file, r["at"]] = (number, depth)
            number, depth, over = number + r["nodes"], depth + r["depth"], r["state"] == "ended"
            if depth < 0:
                raise ValueError(f"unbalanced tree in {file}")
    if depth:
        raise ValueError(f"unbalanced tree in {file}")
    sent = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in ROWS.split(", ")])

        starts, now = sent.value, None
        for key, value in _splits(batches):
            if key not in starts:
                continue
            if now is None or now.key != key:
                if now is not None and (rows := now.end()):
                    yield batch_of(rows)
                now = _Reader(key, *starts[key])
            now.read(value)
            if len(now.rows) > 100_000:
                yield batch_of(now.rows[:-1])  # the last may still get its length
                now.rows = now.rows[-1:]
        if now is not None and (rows := now.end()):
            yield batch_of(rows)

    rows = stage(_pieces(spark, paths).mapInArrow(run, ROWS), "tree")
    asked = rows.filter("kind <> 'open' and level is not null").select("source_file", "at", "level").distinct()
    left = rows.filter("kind = 'open'").select("source_file", "at", "level", F.col("number").alias("opened"))
    earlier = Window.partitionBy("source_file", "level").orderBy("at", F.col("opened").isNotNull())  # a split's own come behind what it asks
    found = asked.withColumn("opened", F.lit(None).cast("bigint")).union(left).withColumn("found", F.last("opened", True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.filter("opened is null").select("source_file", "at", "level", "found")
    met = rows.filter("kind <> 'open'").join(found, ["source_file", "at", "level"], "left")

    nodes = met.filter("kind = 'node'").select("source_file", "number", F.coalesce("parent", "found").alias("parent"), "name", "length")
    labels = met.filter("kind = 'label'").groupBy("source_file", F.coalesce("number", "found").alias("number"))
    labels = labels.agg(F.max("name").alias("own"), F.max("length").alias("own_length"))
    out = nodes.join(labels, ["source_file", "number"], "left")
    name = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.col("name"))
    named = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("node" if c == "number" else c)
    return out.select(F.col("source_file").alias("tree_id"), named("number"), named("parent"), name.alias("name"), F.coalesce("own_length", "length").alias("length"))
