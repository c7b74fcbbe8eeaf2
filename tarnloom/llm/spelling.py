"""Spelling variants: words that one inserted, deleted or replaced character turns into each other.

Each word of the vocabulary emits its full neighbourhood: every different deletion, replacement and insertion over the
alphabet that the vocabulary shows. Neighbours that are words themselves are found by a hash join, so no distance is
computed. A neighbour is built only if its 64-bit hash is set in a bitmap of the vocabulary's hashes, whose size has a
bound; the join behind it is exact, so a crowded bitmap costs a larger shuffle and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, mix64, shuffle_parts, stage

RUN = r"[A-Za-zÀ-ÿ]"
DROP_EVERY = 199  # a run whose checksum this divides loses a character
MAX_BITS = 1 << 27  # most bits of the bitmap (16 MB)
CHUNK = 1 << 16  # bits of the bitmap in one row
CANDIDATES = 1 << 20  # neighbours whose hashes are held at once
_BASE = 0x9E3779B97F4A7C15  # odd


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least that many characters and occurrences. Shorter runs are never taken out of a text."""
    text, run, h = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("run"), F.col("h")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(run).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod(h, F.length(run)).cast("int")
    word = F.when(F.pmod(h, F.lit(DROP_EVERY)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    return mix64((points.astype(np.uint64) * powers(points.shape[1] + 1)[:-1]).sum(1, dtype=np.uint64))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their code points) for each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le"), np.uint32).reshape(-1, n)


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def neighbours(points: np.ndarray, alphabet: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code points) of the neighbours of words of one length, where wanted(hashes) is true; each neighbour of a word once.

    A neighbour's hash follows from sums over the word before and behind the change. Deleting any of several equal characters
    in a row gives the same word, as does inserting one beside them, so only the first place counts.
    """
    m, n = points.shape
    c, a, pw = points.astype(np.uint64), alphabet.astype(np.uint64), powers(n + 2)
    zero = np.zeros((m, 1), np.uint64)
    before = np.hstack([zero, np.cumsum(c * pw[:n], 1, dtype=np.uint64)])  # of the characters before each place
    up, down = c * pw[1 : n + 1], c[:, 1:] * pw[: n - 1]
    behind_up = np.hstack([zero, np.cumsum(up, 1, dtype=np.uint64)])
    behind_down = np.hstack([zero, zero, np.cumsum(down, 1, dtype=np.uint64)])[:, : n + 1]
    same = np.hstack([np.zeros((m, 1), bool), points[:, 1:] == points[:, :-1]])

    deleted = before[:, :n] + behind_down[:, n:] - behind_down[:, 1:]
    row, at = np.nonzero(wanted(mix64(deleted)) & ~same)
    if len(row):
        keep = np.arange(n - 1)[None, :]
        yield row, points[row[:, None], keep + (keep >= at[:, None])]
    step = max(1, CANDIDATES // max(1, m * len(a)))
    for lo in range(0, n, step):
        here = slice(lo, min(n, lo + step))
        h = before[:, n:, None] + (a - c[:, here, None]) * pw[here][None, :, None]
        row, at, which = np.nonzero(wanted(mix64(h)) & (points[:, here, None] != alphabet))
        if len(row):
            out = points[row]
            out[np.arange(len(row)), at + lo] = alphabet[which]
            yield row, out
    last = np.hstack([np.zeros((m, 1), points.dtype), points])  # the character before each place; 0 is in no alphabet
    for lo in range(0, n + 1, step):
        here = slice(lo, min(n + 1, lo + step))
        h = (before[:, here] + behind_up[:, n:] - behind_up[:, here])[:, :, None] + a * pw[here][None, :, None]
        row, at, which = np.nonzero(wanted(mix64(h)) & (last[:, here, None] != alphabet))
        if len(row):
            at = at + lo
            keep = np.arange(n + 1)[None, :]
            out = points[row[:, None], np.minimum(keep - (keep > at[:, None]), n - 1)]
            out[np.arange(len(row)), at] = alphabet[which]
            yield row, out


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """The bits of all words' hashes, two for each word, as bytes; tasks send whole chunks of it, never words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.unique(np.concatenate([np.concatenate(probes(word_hashes(points), bits)) for _, points in by_length(batch.column(0).to_pylist())])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((found // CHUNK).astype(np.int32)), pa.array((found % CHUNK).astype(np.int32))], ["chunk", "bit"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(chunk).tolist():
                held.setdefault(k, np.zeros(CHUNK, bool))[bit[chunk == k]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["chunk", "bytes"])

    parts = min(shuffle_parts(words.sparkSession), max(1, bits // CHUNK))
    rows = words.select("word").mapInArrow(places, "chunk int, bit int").repartition(parts, "chunk").mapInArrow(chunks, "chunk int, bytes binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = r["chunk"] * (CHUNK // 8)
        out[at : at + CHUNK // 8] |= np.frombuffer(r["bytes"], np.uint8)
    return out


def near_words(words: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(word, near, near_n) for every two near words of words (word, n), once in each direction.

    The driver holds the alphabet and the bitmap: at least 64 bits a word, at most max_bits.
    """
    spark = words.sparkSession
    letters = [r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c <> ''").collect()]
    alphabet = np.sort(np.array([ord(c) for c in letters], np.uint32))
    bits = min(max_bits, max(CHUNK, 1 << (64 * max(1, words.count()) - 1).bit_length()))
    sent = spark.sparkContext.broadcast((bitmap(words, bits), alphabet, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, alphabet, bits = sent.value

        def is_set(p: np.ndarray) -> np.ndarray:
            return (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def wanted(h: np.ndarray) -> np.ndarray:
            first, second = probes(h, bits)
            out = is_set(first)
            out[out] = is_set(second[out])
            return out

        for batch in batches:
            words = batch.column(0).to_pylist()
            for at, points in by_length(words):
                step = max(1, CANDIDATES // ((points.shape[1] + 1) * max(1, len(alphabet))))
                for lo in range(0, len(at), step):
                    for row, out in neighbours(points[lo : lo + step], alphabet, wanted):
                        text, n = out.astype("<u4").tobytes().decode("utf-32-le"), out.shape[1]
                        near = [text[k : k + n] for k in range(0, len(text), n)]
                        yield pa.RecordBatch.from_arrays([pa.array([words[at[lo + k]] for k in row.tolist()]), pa.array(near)], ["word", "near"])

    spread = words.select("word").repartition(shuffle_parts(spark), "word")
    return spread.mapInArrow(run, "word string, near string").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def group_variants(docs: DataFrame, times: int = 5, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, how often it occurs, its near words, its form and the last of its forms.

    The form is the near word of largest n (ties: smallest by code points), if that is at least `times` the word's n. Null texts
    have no words; a null id counts as ''. Repeated rows are read alike, an empty table gives no rows, other columns are
    ignored, and texts and words of any length are read whole. Forms are followed by pointer doubling: n grows `times`-fold
    with each, so few rounds end it.
    """
    words = stage(vocabulary(docs, least_length, least_count, id_col, text_col), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    out = stage(out.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")

    links = stage(out.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stage(links.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(links)
        links = moved.select("word", "root")
        links._staged_at = moved._staged_at
        if moved.filter("moved").isEmpty():
            break
    discard(words)
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
