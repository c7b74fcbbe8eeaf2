"""Best-fit packing with several permitted sequence lengths.

Rows are dealt by hash into shards of a bounded number of rows, which are packed independently, so tasks stay small at any
input size. Within a shard pieces go, longest first, into the open bin that they leave least room in. Where none fits, the
bin size of least cost per token that it can still be filled with is opened. At the end each bin shrinks to the smallest
permitted size that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
BIN_COST = 64  # tokens' worth of cost that each sequence has besides its length


def words(text_col: str = "text") -> Column:
    """Tokens of a text: runs of other than space, tab and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...], bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (0 < length <= max(sizes)), and size and contents of each bin."""
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    behind = np.r_[np.cumsum(falling[::-1])[::-1], 0]  # tokens from a position on
    rising = falling[::-1]
    n = len(lengths)
    which, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[int] = []  # distinct rooms of open bins, sorted
    bins: dict[int, list[int]] = {}
    used, opened = [], []
    for k, at in enumerate(order):
        size = int(falling[k])
        found = bisect_left(room, size)
        if found < len(room):
            left = room[found]
            b = bins[left].pop()
            if not bins[left]:
                del bins[left]
                room.pop(found)
        else:
            best = None
            for c in sizes:
                if c < size:
                    continue
                fit = max(k + 1, n - int(np.searchsorted(rising, c - size, "right")))  # later pieces that the rest of the bin could hold
                cost = (c + bin_cost) / min(c, size + int(behind[fit]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, c)
            left, b = best[1], len(used)
            used.append(0)
            opened.append(left)
        which[at], offset[at] = b, used[b]
        used[b] += size
        left -= size
        if left:
            if left not in bins:
                insort(room, left)
                bins[left] = []
            bins[left].append(b)
    full = np.array(used, np.int64)
    return which, offset, np.array(sizes, np.int64)[np.searchsorted(sizes, full)] if n else full, full


_PLACED = "piece long, start long, n_tokens long, shard long, bin long, offset long, bin_used long, bin_size long"


def _place(rows: DataFrame, sizes: tuple[int, ...], shard_rows: int) -> DataFrame:
    """(_row, doc_id, and _PLACED) of staged rows (_row, doc_id, n, h): each shard is packed on its own.

    A shard is dealt by the hash of a row and its number in the staged table, so equal rows spread like others and a shard
    holds about shard_rows rows at most.
    """
    sizes, largest = tuple(sorted(set(sizes))), max(sizes)
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def run(table: pa.Table) -> pa.Table:
        row, h, n = (table.column(c).to_numpy() for c in ("_row", "h", "n"))
        ids = table.column("doc_id").to_pylist()
        whole = np.array([-1 if x is None else x for x in ids], np.int64)
        order = np.lexsort((row, n, h, whole))
        row, n = row[order], n[order]
        pieces = np.maximum(1, -(-n // largest))
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[doc] - piece * largest, largest)
        real = size > 0
        which, offset, bin_size, used = best_fit(size[real], sizes)
        out = {k: np.zeros(len(doc), np.int64) for k in ("bin", "offset", "bin_used", "bin_size")}
        for k, v in (("bin", which), ("offset", offset), ("bin_used", used[which]), ("bin_size", bin_size[which])):
            out[k][real] = v
        shard = np.full(len(doc), table.column("shard")[0].as_py(), np.int64)
        return pa.table({
            "_row": pa.array(row[doc]), "doc_id": pa.array([ids[order[k]] for k in doc], pa.int64()),
            "piece": pa.array(piece), "start": pa.array(piece * largest), "n_tokens": pa.array(size), "shard": pa.array(shard),
            **{k: pa.array(v, mask=~real) for k, v in out.items()},
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("h", "_row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"_row long, doc_id long, {_PLACED}")


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_rows: int = SHARD_ROWS, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start, n_tokens, shard, bin, offset, bin_used, bin_size.

    A document longer than the largest size is cut into pieces of that size and a rest, so every token is placed exactly
    once. A document without tokens (null, empty or blank text) has one row with n_tokens 0 and no bin. Rows without an
    id and repeated rows are packed like others, as rows of their own; an empty table gives no rows; other columns of docs
    are ignored. Bins are numbered within their shard.
    """
    n = words(text_col) if tokens is None else tokens
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), h.alias("h"))
    return _place(stage(rows, "lengths"), sizes, shard_rows).drop("_row")


def sequences(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each bin: shard, bin, bin_size, bin_used, doc_ids, starts and lengths of its pieces, and its tokens.

    The same placement as pack, with the tokens themselves in order of their offsets. A bin holds at most the largest size,
    so what is gathered for it has a bound. Documents without tokens are in no bin.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(rows, "numbered")
    placed = _place(rows.select("_row", "doc_id", words("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")), sizes, shard_rows)
    found = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))
    pieces = placed.filter("n_tokens > 0").join(rows.select("_row", found.alias("_t")), "_row")
    cut = F.slice("_t", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    piece = F.struct("offset", "doc_id", "start", "n_tokens", cut.alias("t"))
    bins = pieces.groupBy("shard", "bin", "bin_size", "bin_used").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return bins.select("shard", "bin", "bin_size", "bin_used", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.n_tokens").alias("lengths"), F.flatten("p.t").alias("tokens"))
