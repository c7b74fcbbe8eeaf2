"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A paragraph ends at a line break or after the mark that ends a sentence. Each distinct paragraph digest adds to one cell in
each third of a table: a count, a sum of digests and a sum of their checks. Tables of two versions subtract; peeling the
difference gives back the digests that only one of them has. Where peeling gets stuck, both are built four times as large.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_parts

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, removed array<long>, added array<long>"
)
BASE = 15  # cells of the table that is written as the fingerprint
_CUT = re.compile(rb"[\r\n]+|(?<=[.!?]) +")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_THIRDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def digests(text: bytes) -> np.ndarray:
    """Sorted distinct digests of the paragraphs; an empty text has none."""
    h = xxhash.xxh64_intdigest
    found = {h(p) for p in _CUT.split(text) if p}
    out = np.fromiter(found, np.uint64, len(found))
    out.sort()
    return out


def _check(d: np.ndarray) -> np.ndarray:
    return mix64(d ^ np.uint64(0x27D4EB2F165667C5)) & np.uint64(0xFFFFFFFF)


def _cells(row: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """(3, n) positions in tables of `size` cells that stand one after another."""
    third = np.uint64(size // 3)
    return np.stack([row.astype(np.uint64) * np.uint64(size) + np.uint64(k) * third + mix64(d ^ s) % third for k, s in enumerate(_THIRDS)]).astype(np.int64)


class Tables:
    """Invertible tables of several rows, side by side: counts, digest sums and check sums modulo 2^64."""

    def __init__(self, rows: int, size: int):
        self.size, self.rows = size, rows
        self.n, self.key, self.check = np.zeros(rows * size, np.int64), np.zeros(rows * size, np.uint64), np.zeros(rows * size, np.uint64)

    def add(self, row: np.ndarray, d: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = _cells(row, d, self.size)
        sign = np.broadcast_to(np.asarray(sign, np.int64), d.shape)
        wide = sign.view(np.uint64) if sign.flags.c_contiguous else np.ascontiguousarray(sign).view(np.uint64)
        for k in range(3):
            np.add.at(self.n, at[k], sign)
            np.add.at(self.key, at[k], d * wide)
            np.add.at(self.check, at[k], _check(d) * wide)

    def peel(self, mask: np.uint64 = _ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and sign of what the tables still hold, and for each row whether all of it came out.

        mask tells which bits of the check sums are known. A cell counts as pure only if it is one of its key's own. One
        that agrees by chance can still be wrong, so a row gives at most as many digests as it has cells, and none twice;
        a row that would fails. So this always ends.
        """
        found_row, found_key, found_sign = [], [], []
        given, failed = np.zeros(self.rows, np.int64), np.zeros(self.rows, bool)
        while True:
            at = np.flatnonzero((np.abs(self.n) == 1) & ~np.repeat(failed, self.size))
            sign = self.n[at]
            key = self.key[at] * sign.view(np.uint64)
            pure = (self.check[at] * sign.view(np.uint64) - _check(key)) & mask == 0
            pure[pure] = (_cells(at[pure] // self.size, key[pure], self.size) == at[pure]).any(0)
            at, sign, key = at[pure], sign[pure], key[pure]
            if not len(at):
                break
            row = at // self.size
            order = np.lexsort((key, row))
            first = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(key[order]) != 0)]
            pick = order[first]
            row, key, sign = row[pick], key[pick], sign[pick]
            self.add(row, key, -sign)
            found_row.append(row)
            found_key.append(key)
            found_sign.append(sign)
            given += np.bincount(row, minlength=self.rows)
            failed |= given > self.size
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        row, key = join(found_row, np.int64), join(found_key, np.uint64)
        order = np.lexsort((key, row))
        twice = (np.diff(row[order]) == 0) & (np.diff(key[order]) == 0)
        failed[row[order][1:][twice]] = True
        done = ~((self.n != 0) | (self.key != 0)).reshape(self.rows, self.size).any(1) & ~failed
        return row, key, join(found_sign, np.int64), done


def written(sets: list[np.ndarray]) -> list[str]:
    """The base table of each set of digests as text."""
    t = Tables(len(sets), BASE)
    if sets:
        t.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    parts = (t.n.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], t.key.astype("<u8").view(np.uint8), t.check.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4])
    table = np.concatenate([np.ascontiguousarray(x).reshape(len(sets), -1) for x in parts], 1)  # all counts, all digests, all checks
    return [base64.b64encode(x.tobytes()).decode() for x in table]


def read_written(text: str) -> Tables:
    """The table that `written` gave; counts, digest sums and check sums are known modulo 2^24, 2^64 and 2^32."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1)
    t = Tables(1, BASE)
    t.n = np.pad(raw[: 3 * BASE].reshape(BASE, 3), ((0, 0), (0, 1))).copy().view("<u4").ravel().astype(np.int64)
    t.key = raw[3 * BASE : 11 * BASE].copy().view("<u8").astype(np.uint64)
    t.check = raw[11 * BASE :].copy().view("<u4").astype(np.uint64)
    return t


def written_difference(a: str, b: str) -> tuple[list[int], list[int]] | None:
    """Digests that only the first and only the second of two written fingerprints hold, by peeling their difference.

    None where it doesn't come out; `differences` of the texts' digests then tries larger tables.
    """
    t, other = read_written(a), read_written(b)
    t.n = (t.n - other.n + (1 << 23)) % (1 << 24) - (1 << 23)
    t.key -= other.key
    t.check = (t.check - other.check) & np.uint64(0xFFFFFFFF)
    _, key, sign, done = t.peel(np.uint64(0xFFFFFFFF))
    return (sorted(key[sign > 0].tolist()), sorted(key[sign < 0].tolist())) if done[0] else None


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair of sets the digests that only the first and only the second has, from the peeled difference of their tables.

    All begin with tables of BASE cells, those that are written; what doesn't come out is tried four times as large. Tables
    of far more cells than digests hold nothing that another size would mend; such a pair is compared digest by digest.
    """
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    only_a, only_b = [np.zeros(0, np.uint64)] * len(a), [np.zeros(0, np.uint64)] * len(a)
    todo, size = np.arange(len(a)), BASE
    while len(todo):
        failed = []
        for at in range(0, len(todo), step := max(1, 2_000_000 // size)):
            some = todo[at : at + step]
            t = Tables(len(some), size)
            own = np.arange(len(some))
            t.add(np.repeat(own, na[some]), np.concatenate([a[k] for k in some]), 1)
            t.add(np.repeat(own, nb[some]), np.concatenate([b[k] for k in some]), -1)
            row, key, sign, done = t.peel()
            for out, kind in ((only_a, 1), (only_b, -1)):
                mine = sign == kind
                order = np.lexsort((key[mine], row[mine]))
                keys, rows = key[mine][order], row[mine][order]
                cuts = np.searchsorted(rows, np.arange(len(some) + 1))
                for k in np.flatnonzero(done):
                    out[some[k]] = keys[cuts[k] : cuts[k + 1]]
            failed.append(some[~done])
            for k in failed[-1][size > 64 * (na + nb)[failed[-1]] + 64 * BASE]:
                only_a[k], only_b[k] = np.setdiff1d(a[k], b[k]), np.setdiff1d(b[k], a[k])
            failed[-1] = failed[-1][size <= 64 * (na + nb)[failed[-1]] + 64 * BASE]
        todo, size = np.concatenate(failed), size * 4
    return only_a, only_b


def shared(na: np.ndarray, only_a: list[np.ndarray], only_b: list[np.ndarray]) -> np.ndarray:
    """Shared digests over all digests of each pair; two empty sets are alike."""
    left, right = np.array([len(x) for x in only_a]), np.array([len(x) for x in only_b])
    return np.where(na + right > 0, (na - left) / np.maximum(na + right, 1), 1.0)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared digests over all digests of each pair of sets."""
    return shared(np.array([len(x) for x in a]), *differences(a, b))


def range_cuts(rows: DataFrame, ranges: int) -> list[tuple]:
    """Keys (known, doc_id, h, salt), falling, that divide the rows into about equal ranges: quantiles of a bounded sample."""
    n = rows.count()
    if ranges < 2 or not n:
        return []
    some = rows.sample(min(1.0, 64 * ranges / n), seed=3).select("key").orderBy(F.desc("key")).collect()
    cuts = [tuple(some[len(some) * k // ranges]["key"]) for k in range(1, ranges)] if some else []
    return list(dict.fromkeys(cuts))


def range_of(cuts: list[tuple]) -> Column:
    """How many cuts lie above the column `key`. Cuts are tested in blocks first, then within one, so a row meets few of them."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    kind = "struct<known:int,doc_id:bigint,h:bigint,salt:bigint>"
    literal = lambda some: ",".join(f"named_struct('known',{k},'doc_id',{i}L,'h',{h}L,'salt',{s}L)" for k, i, h, s in some)
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    tops = F.expr(f"cast(array({literal(x[0] for x in blocks)}) as array<{kind}>)")
    every = F.expr(f"cast(array({','.join(f'array({literal(x)})' for x in blocks)}) as array<array<{kind}>>)")
    at = F.size(F.filter(tops, lambda c: c > F.col("key")))  # blocks that begin above the key
    inside = F.coalesce(F.size(F.filter(F.get(every, at - 1), lambda c: c > F.col("key"))), F.lit(0))
    return F.when(at == 0, 0).otherwise((at - 1) * width + inside).cast("int")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its fingerprint, that of its edited text, and how alike they are to it and to the next row.

    The next row is that with the next smaller doc_id; rows that share an id follow by the hash of their text, rows without
    an id come last, and after the last row comes the first. The edited text is the text with its last floor(n_chars / 3) code points
    replaced by as many (or all) first ones of the next text. Null texts count as empty; empty texts have an empty
    table. An empty table gives no rows; other columns of docs are ignored. Nothing is lost if the rows come in another order
    each time they are read. removed and added are the paragraph digests that
    only the text and only the edited text have.

    Texts are shuffled once, into ranges of that order. Equal rows, also those without an id, are dealt by their place in the
    scan, so they fill as many ranges as they need; only each range's first row is sent to the range before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("h"), F.col("salt"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}).withColumn("key", key)
    cuts = range_cuts(rows, shuffle_parts(spark))
    rows = rows.withColumn("part", range_of(cuts))
    tops = {r["part"]: r["top"] for r in rows.groupBy("part").agg(F.max("key").alias("top")).collect()}  # one row for each range
    order = sorted(tops)
    follows = [(order[k - 1], tops[order[k]]["known"], tops[order[k]]["doc_id"], tops[order[k]]["h"]) for k in range(len(order))]
    firsts = F.broadcast(spark.createDataFrame(follows, "goes_to int, kk int, ii long, hh long"))
    # A range's first row is told by its id and text alone: rows that agree in both are alike, in whatever order a job reads them.
    same = (F.col("key.known") == F.col("kk")) & (F.col("key.doc_id") == F.col("ii")) & (F.col("h") == F.col("hh"))
    extra = rows.join(firsts, same).groupBy(F.col("goes_to").alias("part")).agg(F.min(F.struct("text", "key")).alias("x"))
    extra = extra.select("x.text", "part", "x.key", F.lit(1).alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            """All but the last of the waiting rows, each with its next."""
            sets = [x[4] for x in waiting]
            own = [k for k, x in enumerate(waiting[:-1]) if not x[3]]
            if not own:
                return
            edited = []
            for k in own:
                text, nxt = waiting[k][1].decode("utf-8", "replace"), waiting[k + 1][1].decode("utf-8", "replace")
                cut = len(text) // 3
                edited.append((text[: len(text) - cut] + nxt[:cut]).encode("utf-8"))
            new = [digests(x) for x in edited]
            old, following = [sets[k] for k in own], [sets[k + 1] for k in own]
            removed, added = differences(old, new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([waiting[k][0] for k in own], pa.int64()),
                    pa.array([len(waiting[k][1].decode("utf-8", "replace")) for k in own], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    pa.array(written(old)),
                    pa.array(written(new)),
                    pa.array(shared(np.array([len(x) for x in old]), removed, added)),
                    pa.array(likeness(old, following)),
                    pa.array([x.view(np.int64) for x in removed], pa.list_(pa.int64())),
                    pa.array([x.view(np.int64) for x in added], pa.list_(pa.int64())),
                ],
                [x.split(" ")[0] for x in RESULT.split(", ")],
            )

        size = 0
        for batch in batches:
            for i, t, e in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("extra").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                held.append((i, raw, None, e, digests(raw)))
                size += len(raw)
                if size > 4_000_000 and len(held) > 1:
                    yield from flush(held)
                    held, size = held[-1:], len(raw)
        if held:
            yield from flush(held)

    everything = rows.select("text", "part", "key", F.lit(0).alias("extra")).unionByName(extra)
    ranged = everything.repartitionById(max(1, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "extra", F.desc("key"))
    own = F.when(F.col("key.known") == 1, F.col("key.doc_id")).alias("doc_id")
    return ranged.select(own, "text", "extra").mapInArrow(run, RESULT)
