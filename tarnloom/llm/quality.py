"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, held_out, text_bytes

MAX_LABELLED = 20_000  # labelled rows that the ranking is fitted on, chosen by hash
PAIRS_EACH = 4  # pairs that each sampled row is in with rows of the other label, drawn for it
LEXICAL = 32  # hashed features of a text's distinct words
FEATURES = (
    "log_words", "odd_symbols", "upper", "bars", "shouts", "same_as_before", "distinct", "repeated_lines", "digits",
    "word_length", "symbol_runs", "any_symbol_run", *[f"words_{k}" for k in range(LEXICAL)],
)
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_PLAIN = _LETTER + _DIGIT + b" \t\r\n.,;:'\"-?()"
_RUN = re.compile(rb"([!-/:-@\[-`{-~])\1")


def features(text: bytes) -> list[float]:
    """Ratios in 0 to about 1, most under a square root so that small shares count; an empty text gives zeros.

    The last LEXICAL ones are the shares of distinct lower-case words by their hash.
    """
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * len(FEATURES)
    less = lambda kind: n - len(text.translate(None, kind))
    letters = max(1, less(_LETTER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = sum(1 for _ in _RUN.finditer(text))
    distinct = set(words)
    lexical = np.bincount([crc32(x) % LEXICAL for x in {x.lower() for x in distinct}], minlength=LEXICAL) / len(distinct)
    return [
        np.log1p(w) / 10,
        ((n - less(_PLAIN)) / n) ** 0.5,
        (less(_UPPER) / letters) ** 0.5,
        min(1.0, text.count(b"|") / w) ** 0.5,
        min(1.0, text.count(b"!") / w) ** 0.5,
        (sum(map(eq, words, words[1:])) / w) ** 0.5,
        len(distinct) / w,
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        (less(_DIGIT) / n) ** 0.5,
        min(2.0, n / w / 10),
        min(1.0, runs / w) ** 0.5,
        float(runs > 2),
        *lexical.tolist(),
    ]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled ids outside the held-out fold; one row for each id, on the driver.

    Of labels that share an id the largest counts, of documents that share one that with the least text hash.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = hash_sample(known, most, "id").toPandas()
    ids = docs.sparkSession.createDataFrame(known[["id", "y"]], "id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            x = [features(data[at[k] : at[k + 1]].tobytes()) for k in range(batch.num_rows)]
            arrays = [batch.column("id"), batch.column("h"), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "x"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.join(F.broadcast(ids), "id").select("id", "h", "text")  # ids of a bounded number
    x = rows.mapInArrow(run, "id long, h long, x array<double>").groupBy("id").agg(F.min(F.struct("h", "x")).alias("r"))
    got = x.select("id", "r.x").toPandas().merge(known, on="id").sort_values("id")
    return np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(int)


def draw_pairs(y: np.ndarray, each: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Better and worse row of each pair: every row is in at least `each` of them."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better = np.r_[rng.choice(good, len(bad) * each), np.repeat(good, each)]
    return better, np.r_[np.repeat(bad, each), rng.choice(bad, len(good) * each)]


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 5, ridge: float = 1.0, at: float = 0.3, each: int = PAIRS_EACH) -> dict:
    """Weights from pairs (better, worse) of rows, by Newton steps on the logistic loss of their differences.

    The cut is the quantile of training scores at the share of worse rows; the score there becomes `at`. Without both
    labels there is nothing to rank: weights are 0 and every score is 0.5.
    """
    width = x.shape[1] if x.size else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "cut": 0.0, "base": 0.0}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    better, worse = draw_pairs(y, each, seed)
    d = z[better] - z[worse]
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(width), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    low, high = np.sort(raw)[max(0, len(bad) - 1)], np.sort(raw)[min(len(raw) - 1, len(bad))]
    return {"mean": mean, "scale": scale, "w": w, "cut": float(low + high) / 2, "base": float(np.log(at / (1 - at)))}


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", at: float = 0.3, max_labelled: int = MAX_LABELLED, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Learned from at most max_labelled labelled ids outside the held-out fold (all, if there are fewer; chosen by hash of
    the id), each in at least pairs_each pairs. Labels other than 0 and 1 are ignored. Null and empty texts get the score of
    all-zero features; texts are read whole. Repeated rows are scored alike, rows without an id count as held out; without both
    labels every score is 0.5; an empty table gives no rows. Other columns of docs are ignored.
    """
    m = fit_pairs(*_sample(docs, labels, id_col, text_col, label_col, max_labelled), at=at, each=pairs_each)
    weights = m["w"] / m["scale"]
    shift = m["base"] - float(m["cut"] + m["mean"] @ weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at_ = text_bytes(batch.column("text"))
            raw = np.array([np.dot(features(data[at_[k] : at_[k + 1]].tobytes()), weights) for k in range(batch.num_rows)])
            score = 1 / (1 + np.exp(-np.clip(raw + shift, -700, 700))) if weights.any() else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))
