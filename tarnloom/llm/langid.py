"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every learnable row, summed per task before the shuffle. The log-probability matrix
(languages x buckets, a fixed number of buckets) is broadcast, and batches are scored sparsely in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import characters, held_out, text_bytes

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_LABELS = 400  # the matrix of labels x BUCKETS is broadcast, so its size has a bound


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Every code point to its lower case if it is a letter, else to 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each n-gram counted from the first, its bucket) piece by piece; n-grams never cross rows.

    A part of a long row begins with the last two characters of the one before; n-grams that end in those were given with it.
    """
    for lo, bounds, points, carried, _ in characters(data, offsets, carry=max(ORDERS) - 1):
        c = letters()[points]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        h = np.zeros(len(c), np.uint32)
        for n in ORDERS:
            k = len(c) - n + 1
            if k <= 0:
                break
            h = (h[:k] + c[n - 1 :]) * np.uint32(0x9E3779B1) if n > 1 else c * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            on = c[:k] > 0 if n == 1 else (row[:k] == row[n - 1 :]) & ((c[:k] > 0) | (c[n - 1 :] > 0))
            on[: max(0, carried - n + 1)] = False
            yield lo, len(bounds) - 1, row[:k][on], (h[on] * np.uint32(0x85EBCA77)) >> np.uint32(18)


def counts(rows: DataFrame, label: str, text_col: str = "text") -> DataFrame:
    """(label, bucket, n): how often each bucket occurs under each label; a task emits at most labels x BUCKETS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            names = sorted(set(labels))
            place = {x: k for k, x in enumerate(names)}
            code = np.array([place[x] for x in labels])
            for x in names:
                seen.setdefault(x, np.zeros(BUCKETS, np.int64))
            for lo, n, row, bucket in grams(*text_bytes(batch.column(1))):
                own = code[lo : lo + n][row]
                for k in np.unique(own):
                    seen[names[k]] += np.bincount(bucket[own == k], minlength=BUCKETS)
        for name, n in seen.items():
            at = np.flatnonzero(n)
            arrays = [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "bucket", "n"])

    got = rows.select(F.col(label).cast("string").alias("label"), F.col(text_col).alias("text"))
    got = got.mapInArrow(run, "label string, bucket int, n long")
    return got.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, label: str = "lang", text_col: str = "text", smoothing: float = 0.5, max_labels: int = MAX_LABELS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, log-probabilities (labels x BUCKETS) and log-priors, from all rows whose label is not null.

    ValueError for more than max_labels different labels: the matrix goes to the driver and to every task.
    """
    rows = rows.filter(F.col(label).isNotNull())
    prior = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().limit(max_labels + 1).collect()}
    if len(prior) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    got = counts(rows, label, text_col).toPandas()
    names = sorted(prior)
    n = np.full((len(names), BUCKETS), smoothing)
    if names:
        place = {x: k for k, x in enumerate(names)}
        np.add.at(n, ([place[x] for x in got["label"]], got["bucket"].to_numpy(int)), got["n"].to_numpy(float))
    total = np.array([prior[x] for x in names], float)
    return names, np.log(n / n.sum(1, keepdims=True)), np.log(total / total.sum()) if names else total


def log_likelihoods(data: np.ndarray, offsets: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Rows x labels: the sum over each row's n-grams of their log-probabilities (log_p: labels x BUCKETS).

    Only the cells that occur are looked up, label by label, so memory stays with one piece of text.
    """
    total = np.zeros((len(offsets) - 1, len(log_p)))
    for lo, _, row, bucket in grams(data, offsets):
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            for k, cells in enumerate(log_p):
                total[lo + row[first], k] += np.add.reduceat(cells[bucket], first)
    return total


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; score is the posterior of the named language.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned. Texts are
    read whole, whatever their length. Ties go to the first name in order. Repeated rows are scored alike, rows without
    an id count as held out, an empty table gives no rows, and other columns of docs are ignored.
    """
    names, log_p, prior = model
    sent = docs.sparkSession.sparkContext.broadcast((names, log_p, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p, prior = sent.value
        for batch in batches:
            if names:
                total = log_likelihoods(*text_bytes(batch.column("text")), log_p) + prior
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            pred = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col(text_col)
    has_letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"), has_letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
