"""Objects of large JSON arrays, read by as many tasks as a file has splits.

A file is read as pieces that end in `}`. Whether a piece begins inside a string, and how deep, follows from all before it, so
a first pass gives one row a split: the parity of its quotes and its change of depth, for either parity that it may begin
with. Carried over the splits, these rows tell where each begins. A second pass then cuts whole objects out of each split;
only objects that lie across splits are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage
from .text_records import with_ordinal

MARKS = re.compile(r'["\[\]{}]')
ESCAPE = re.compile(r"\\.", re.S)
KEY = re.compile(r'"([^"]*)"\s*:\s*$')
INDEX = "source_file string, at long, parity int, out_depth long, in_depth long, bytes long"
#: An object, or a part of one across splits, with its array's key and the commas before it in that array and split. Without
#: a text: all commas of an array in the split, or the array that is open at its end.
FOUND = "source_file string, at long, key string, part string, commas long, text string"
TOP, NONE, UNKNOWN = "[]", "-", "?"  # of keys: the file's own array, no array, the one that earlier splits have opened


def _unescaped(piece: str) -> str:
    return ESCAPE.sub("  ", piece) if "\\" in piece else piece


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, at, value): what stands before each `}`, or behind the last, in order within a split."""
    return with_ordinal(spark.read.option("lineSep", "}").text(path)).select("source_file", F.col("ordinal.at").alias("at"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("source_file", "at", "value")), strict=True)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[int]] = {}
    for file, at, value in _by_split(batches):
        row = held.setdefault((file, at), [0, 0, 0, 0])
        for k, part in enumerate(_unescaped(value).split('"')):
            side = 1 + (row[0] + k) % 2  # out of strings if the split begins out of one, else if it begins inside
            row[side] += part.count("{") + part.count("[") - part.count("]") - part.count("}")
        row[0] += k
        row[1 + row[0] % 2] -= 1  # the piece's own `}`
        row[3] += len(value.encode()) + 1
    if held:
        rows = [(*key, row[0] % 2, *row[1:]) for key, row in held.items()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in INDEX.split(", ")])


class _Split:
    """Reads on through the pieces of one split from the state in which it begins, and lists what it finds (rows of FOUND)."""

    def __init__(self, file: str, at: int, inside: bool, depth: int, top: str):
        self.file, self.at, self.inside, self.depth = file, at, inside, depth
        self.base = 1 if top == "[" else 2  # the depth at which objects of an array lie
        self.key = TOP if top == "[" else UNKNOWN if at else NONE
        self.open = depth > self.base  # an object of the array, begun in an earlier split
        self.begun, self.held, self.commas, self.rows = not self.open, [], 0, []

    def add(self, part: str, text: str | None) -> None:
        if self.key != NONE:
            self.rows.append((self.file, self.at, self.key, part, self.commas, text))

    def read(self, value: str) -> None:
        plain, value, since, start = _unescaped(value) + "}", value + "}", 0, 0
        for m in MARKS.finditer(plain):
            c, at = m.group(), m.start()
            if self.inside:
                self.inside = c != '"'
                since = at + 1
                continue
            if self.depth == self.base:
                self.commas += plain.count(",", since, at)
            since = at + 1
            if c == '"':
                self.inside = True
            elif c in "[{":
                if c == "[" and self.base == 2 and self.depth == 1:
                    named = KEY.search(plain, 0, at)
                    self.key, self.commas = named.group(1) if named else NONE, 0
                elif c == "{" and self.depth == self.base and self.key != NONE:
                    self.open, start = True, at
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.base and self.open:
                    self.add("whole" if self.begun else "end", "".join(self.held) + value[start : at + 1])
                    self.open, self.begun, self.held = False, True, []
                elif c == "]" and self.depth == self.base - 1:
                    self.add("array", None)
                    self.key, self.commas = NONE, 0
        if self.open:
            self.held.append(value[start:])

    def end(self) -> list[tuple]:
        if self.open:
            self.add("begin" if self.begun else "middle", "".join(self.held))
        self.add("array", None)
        self.rows.append((self.file, self.at, self.key, "state", self.commas, None))
        return self.rows


def objects_of(texts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """What scan_objects gives, from texts (source_file, value) that are whole JSON values, each read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top = value.lstrip()[:1]
                if top not in ("[", "{"):
                    continue
                now = _Split(file, 0, False, 0, top)
                now.read(value)
                keys = {r[2] for r in now.rows if r[3] == "array"}
                key = next((k for k in (TOP, *names) if k in keys), None)
                if key is not None and now.depth == -1 and not now.inside:  # reading on behind the text counts one bracket more
                    rows = [(r[4], r[5]) for r in now.rows if r[2] == key and r[5] is not None]
                    lines, found = [k for k, _ in rows], [t for _, t in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(lines, pa.int32()), pa.array(found, pa.string())], ["source_file", "source_line", "value"])

    return texts.select("source_file", "value").mapInArrow(run, "source_file string, source_line int, value string")


def _starts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, at, inside, depth): the state in which each split begins; a row a split.

    Files whose quotes or brackets don't end even are left out.
    """
    index = _pieces(spark, path).mapInArrow(_index, INDEX).groupBy("source_file", "at").agg(*[F.sum(c).alias(c) for c in ("parity", "out_depth", "in_depth", "bytes")])
    before = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file")
    index = index.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    index = index.withColumn("change", F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth")))
    index = index.withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "left": F.sum("change").over(whole), "quotes": F.sum("parity").over(whole), "bytes": F.sum("bytes").over(whole)})
    # What stands behind the last `}` counts as if one followed; then the pieces hold a byte more than the file.
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "length")
    index = index.join(files, "source_file").filter((F.col("left") == F.col("length") - F.col("bytes")) & (F.col("quotes") % 2 == 0))
    return index.select("source_file", "at", "inside", "depth")


def scan_objects(spark: SparkSession, path: str | list[str], names: tuple[str, ...]) -> DataFrame:
    """(source_file, source_line, value): the text of each object of a JSON array, and its place there.

    The array is the file's value, or that of the first of `names` that an object has as an array; other elements than
    objects only count for places. Files whose brackets don't match give nothing. The driver holds a row a split.
    """
    starts = {(r["source_file"], r["at"]): (r["inside"], r["depth"]) for r in _starts(spark, path).collect()}
    first = _pieces(spark, path).filter("at = 0").groupBy("source_file").agg(F.first("value").alias("value"))
    tops = {r[0]: r[1] for r in first.select("source_file", F.regexp_extract("value", r"^\s*(.)", 1)).collect()}
    sent = spark.sparkContext.broadcast((starts, tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in FOUND.split(", ")])

        starts, tops = sent.value
        now, size = None, 0
        for file, at, value in _by_split(batches):
            if (file, at) not in starts or tops.get(file) not in ("[", "{"):
                continue
            if now is None or (now.file, now.at) != (file, at):
                if now is not None:
                    yield batch_of(now.end())
                now, size = _Split(file, at, *starts[file, at], tops[file]), 0
            now.read(value)
            size += len(value)
            if size > 4_000_000 and now.rows:
                yield batch_of(now.rows)
                now.rows, size = [], 0
        if now is not None:
            yield batch_of(now.end())

    found = stage(_pieces(spark, path).mapInArrow(run, FOUND), "objects")
    in_order = Window.partitionBy("source_file").orderBy("at")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("key") != UNKNOWN, F.col("key"))
    states = found.filter("part = 'state'").select("source_file", "at", F.last(known, True).over(before).alias("from_before"))
    named = found.join(states, ["source_file", "at"]).withColumn("key", F.when(F.col("key") == UNKNOWN, F.col("from_before")).otherwise(F.col("key")))
    rank = F.array_position(F.array(*map(F.lit, (TOP, *names))), F.col("key"))
    arrays = named.filter((F.col("part") == "array") & (rank > 0)).groupBy("source_file", "key", "at").agg(F.max("commas").alias("commas"))
    chosen = arrays.groupBy("source_file").agg(F.min(F.struct(rank, "key")).alias("k")).select("source_file", F.col("k.key").alias("key"))
    passed = F.sum("commas").over(Window.partitionBy("source_file", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    arrays = arrays.join(chosen, ["source_file", "key"]).select("source_file", "key", "at", F.coalesce(passed, F.lit(0)).alias("passed"))
    named = named.filter("text is not null").join(arrays, ["source_file", "key", "at"])

    whole = named.filter("part = 'whole'").select("source_file", (F.col("passed") + F.col("commas")).cast("int").alias("source_line"), F.col("text").alias("value"))
    begun = F.last(F.when(F.col("part") == "begin", F.col("at")), True)
    earlier = Window.partitionBy("source_file").orderBy("at", F.col("part") == "begin").rowsBetween(Window.unboundedPreceding, -1)  # an end comes first
    parts = named.filter("part <> 'whole'").withColumn("begins", begun.over(earlier))
    parts = parts.withColumn("begins", F.when(F.col("part") == "begin", F.col("at")).otherwise(F.col("begins")))
    line = F.min(F.when(F.col("part") == "begin", F.col("passed") + F.col("commas"))).cast("int").alias("source_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("value")
    across = parts.groupBy("source_file", "begins").agg(line, text).select("source_file", "source_line", "value")
    return whole.union(across)
