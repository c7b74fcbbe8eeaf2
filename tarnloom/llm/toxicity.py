"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token written with digits or symbols for letters, with repeated letters, or one letter at a time is a lattice of
characters. Viterbi decoding under a trigram character model, counted over all documents, restores it. A logistic model on
whole words and word beginnings scores the restored words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import characters, discard, hash_sample, held_out, quoted, stage, text_bytes

MAX_LABELLED = 20_000  # labelled rows that the score is fitted on, chosen by hash
LEAST_DOCS = 4  # toxic documents that must share a feature
LEAST_RATIO = 2.25  # nats by which a feature must be likelier in toxic documents
STEMS = (4, 5, 6)
CACHE, CACHED = 300_000, 64  # tokens that a task remembers, and characters of the longest of them
SETTLE = 512  # steps of a lattice after which what all its paths share is written down

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}

#: Costs of the channel in nats: a sign for a letter, a sign dropped, a digit dropped, a letter doubled, a letter in a
#: longer run, a space put in where letters stand alone.
SIGN, DROP, DROP_DIGIT, TWICE, RUN, GAP = 1.0, 7.0, 14.0, 4.0, 0.2, 1.0
CLASSES = 28  # 0 boundary, 1-26 letters, 27 any other letter
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(<€£])(?:[\s._*-]{1,3}(?:[^\W_]|[@$!|+(<€£])){2,}(?!\w)")
_EDGE = " \t\r\n.,;:?!\"'`*#%&~^_-=/\\[]{})>"
_TWICE = re.compile(r"(\w)\1")


def _class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, after lower-casing."""
    return np.fromiter((_class_of(chr(c).lower()[0]) for c in range(0x110000)), np.uint32, 0x110000)


def count_characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts of the character classes of each text with two boundaries before and behind it."""
    total, table = np.zeros(CLASSES**3, np.int64), _classes()
    for _, bounds, points, carried, ends in characters(data, offsets):
        rows = len(bounds) - 1
        if carried:
            c = np.r_[table[points], np.zeros(2 * ends, np.uint32)]
        else:
            c = np.zeros(len(points) + 2 * rows + 2 * ends, np.uint32)
            c[np.arange(len(points)) + 2 * np.repeat(np.arange(1, rows + 1), np.diff(bounds))] = table[points]
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    return total


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of character classes over all documents: CLASSES^3 cells, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            total += count_characters(*text_bytes(batch.column(0)))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    cells = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell int, n long")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES**3)
    out[got["cell"].to_numpy(int)] = got["n"].to_numpy(float)
    return out.reshape(CLASSES, CLASSES, CLASSES)


def character_model(n: np.ndarray) -> list:
    """Negative log-probabilities [a][b][c] of c after a, b, interpolated with the shorter contexts."""
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    three = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
    return (-np.log(three)).tolist()


def _marked(token: str) -> Iterator[tuple[str, float]]:
    """Characters with the cost of reading each as a repetition; runs of three or more come as two, the second nearly free."""
    for m in re.finditer(r"(.)\1*", token, re.S):
        yield m[1], TWICE
        if len(m[0]) > 1:
            yield m[1], RUN if len(m[0]) > 2 else TWICE


def decode(token: str, cost: list, spaced: bool = False) -> str:
    """Cheapest reading of a token: letters as they are or repeated, signs as letters or dropped, gaps where letters stand alone.

    A token is one lattice whatever its length; what all paths share is written down on the way, so memory stays with the
    steps since then.
    """
    paths: dict = {(0, 0, ""): (0.0, None)}  # two last classes, last letter -> cost, text as (last piece, what comes before)
    done, waited, due = [], 0, SETTLE
    for c, repeat in _marked(token):
        if c.isalpha() and not spaced:
            paths = _plain_step(paths, cost, c, repeat)
        else:
            paths = _step(paths, cost, c, repeat, spaced)
        waited += 1
        if waited >= due:
            settled, paths = _settle(paths)
            done.append(settled)
            waited, due = (0, SETTLE) if settled else (waited, 2 * due)
    best = min((k + cost[a][b][0], "".join(x[0] for x in _chain(text))) for (a, b, _), (k, text) in paths.items())
    return "".join(done) + best[1]


def _plain_step(paths: dict, cost: list, c: str, repeat: float) -> dict:
    """What _step does for a letter of a token without spaces, which can only be read as itself."""
    cls, nxt = _class_of(c), {}
    for (a, b, last), (k, text) in paths.items():
        key, k2 = (b, cls, c), k + cost[a][b][cls]
        if (old := nxt.get(key)) is None or k2 < old[0]:
            nxt[key] = (k2, (c, text))
        if c == last:
            key, k2 = (a, b, c), k + repeat
            if (old := nxt.get(key)) is None or k2 < old[0]:
                nxt[key] = (k2, text)
    return nxt


def _step(paths: dict, cost: list, c: str, repeat: float, spaced: bool) -> dict:
    """The cheapest path to each state after one more character, whichever way it is read."""
    alpha, nxt = c.isalpha(), {}
    letters = c if alpha else LEET.get(c, "")
    for (a, b, last), (k, text) in paths.items():
        moves = []
        for x in letters:
            cls, own = _class_of(x), 0.0 if alpha else SIGN
            moves.append((b, cls, x, k + own + cost[a][b][cls], (x, text)))
            if x == last:
                moves.append((a, b, last, k + own + repeat, text))
            if spaced and b:
                k2 = k + GAP + own + cost[a][b][0] + cost[b][0][cls]
                moves.append((0, cls, x, k2, (" " + x, text)))
        if not alpha:
            drop = (DROP_DIGIT if c.isdigit() else DROP) if letters else 0.0
            moves.append((a, b, last, k + drop, text))
        for a2, b2, l2, k2, t2 in moves:
            if (old := nxt.get((a2, b2, l2))) is None or k2 < old[0]:
                nxt[(a2, b2, l2)] = (k2, t2)
    return nxt


def _chain(text: tuple | None) -> list[tuple]:
    out = []
    while text:
        out.append(text)
        text = text[1]
    return out[::-1]


def _settle(paths: dict) -> tuple[str, dict]:
    """The beginning that all paths share, and the paths without it."""
    chains = {key: _chain(text) for key, (_, text) in paths.items()}
    first, n = next(iter(chains.values())), 0
    while all(n < len(x) and x[n] is first[n] for x in chains.values()):
        n += 1
    out = {}
    for key, (k, _) in paths.items():
        text = None
        for piece, _ in chains[key][n:]:
            text = (piece, text)
        out[key] = (k, text)
    return "".join(x[0] for x in first[:n]), out


def restore(token: str, cost: list) -> str:
    """A lower-case token as it was meant; one that is spelled plainly only loses signs at its ends.

    A "!" right before the first letter stays, as it may stand for an i; at the end it is punctuation.
    """
    core = token.strip(_EDGE)
    if core and core[0].isalpha() and token[: token.index(core)].endswith("!"):
        core = "!" + core
    if not core or core.isalpha() and not _TWICE.search(core):
        return core
    if not any(c.isalpha() for c in core) or core.replace(".", "").replace(",", "").isdigit():
        return ""
    return decode(core, cost)


def spaced_words(text: str, cost: list) -> Iterator[str]:
    """Words that stand in text one letter at a time; a run is one lattice, as a cut could fall into a word."""
    for m in _SPACED.finditer(text):
        yield from decode("".join(c for c in m[0] if c.isalpha() or c in LEET), cost, spaced=True).split()


def _keys(word: str) -> list[str]:
    """Features of a word: itself, by its hash if it is very long, and its beginnings."""
    whole = "=" + word if len(word) <= CACHED else "#" + xxhash.xxh64_hexdigest(word)
    return [whole, *(word[:n] for n in STEMS if len(word) > n)]


class Restorer:
    """The distinct restored words of a text, with a memory for short tokens."""

    def __init__(self, cost: list):
        self.cost, self.seen = cost, {}

    def token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _TWICE.search(token):
            return (token,)
        words = restore(token, self.cost).split()
        if "!" in token and "!" in token[: token.index(core := token.strip(_EDGE))]:
            words += restore(core, self.cost).split()  # a leading "!" may be a letter or a mark: both readings count
        return tuple(dict.fromkeys(words))

    def remembered(self, token: str) -> tuple[str, ...]:
        if (got := self.seen.get(token)) is None:
            got = self.token(token)
            if len(token) <= CACHED:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[token] = got
        return got

    def __call__(self, raw: bytes) -> set[str]:
        text = raw.decode("utf-8", "replace").lower()
        out: set[str] = set()
        for t in set(text.split()):
            out.update(self.remembered(t))
        out.update(spaced_words(text, self.cost))
        return out


class Scorer:
    """The raw score of a text: the bias and the weights of the features that its restored words have."""

    def __init__(self, model: dict):
        self.restorer, self.bias = Restorer(model["cost"]), model["bias"]
        self.weight = dict(zip(model["keys"], model["w"], strict=True))
        self.telling: dict[str, tuple[str, ...]] = {}
        self.without: set[str] = set()

    def features(self, words: Iterable[str]) -> tuple[str, ...]:
        return tuple({x: None for w in words for x in _keys(w) if x in self.weight})

    def token(self, token: str) -> tuple[str, ...]:
        if (got := self.telling.get(token)) is None:
            got = self.features(self.restorer.token(token))
            if len(token) <= CACHED:
                if len(self.telling) + len(self.without) >= CACHE:
                    self.telling.clear()
                    self.without.clear()
                if got:
                    self.telling[token] = got
                else:
                    self.without.add(token)
        return got

    def __call__(self, raw: bytes) -> float:
        text, found = raw.decode("utf-8", "replace").lower(), set()
        for t in set(text.split()) - self.without:
            found.update(self.token(t))
        found.update(self.features(spaced_words(text, self.restorer.cost)))
        return self.bias + sum(self.weight[x] for x in sorted(found))


def _sample(docs: DataFrame, labels: DataFrame, cost: list, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(y, words) of at most `most` labelled ids outside the held-out fold: their restored words, joined by spaces.

    The ids are a broadcast of that bounded size. Of documents that share an id, the one with the least text hash counts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = hash_sample(known, most, "id").toPandas()
    ids = docs.sparkSession.createDataFrame(known[["id", "y"]], "id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(cost)
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                words = [" ".join(sorted(read(data[at[k] : at[k + 1]].tobytes()))) for k in range(lo, lo + some.num_rows)]
                arrays = [some.column("id"), some.column("y"), some.column("h"), pa.array(words, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "y", "h", "words"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.join(F.broadcast(ids), "id").select("id", "y", "h", "text")
    words = rows.mapInArrow(run, "id long, y int, h long, words string")
    one = words.groupBy("id").agg(F.min(F.struct("h", "words", "y")).alias("r")).select("r.y", "r.words")
    return stage(one, "sample")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict:
    """Character model over all documents; features and weights from a bounded labelled sample outside the held-out fold.

    A feature is a restored word or its beginning that at least LEAST_DOCS toxic documents of the sample share; there are
    no more of them than the sample's words give. A text without any is never likelier toxic than the sample's share.
    """
    cost = character_model(character_counts(docs, text_col))
    sample = _sample(docs, labels, cost, label_col, id_col, text_col, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, words = batch.column("y").to_numpy(), batch.column("words").to_pylist()
            for lo in range(0, batch.num_rows, 512):
                n = (Counter(), Counter())  # documents with a feature, clean and toxic
                for k, t in enumerate(words[lo : lo + 512], lo):
                    n[y[k]].update({x for w in t.split(" ") if w for x in _keys(w)})
                keys = sorted(n[0].keys() | n[1].keys())
                arrays = [pa.array(keys, pa.string()), *(pa.array([c[x] for x in keys], pa.int64()) for c in n[::-1])]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "toxic", "clean"])

    totals = sample.groupBy().agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    n1, n0 = int(totals[0]), int(totals[1] - totals[0])
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else -1.0
    model = {"cost": cost, "keys": [], "w": np.zeros(0), "bias": prior}
    if not n1:
        discard(sample)
        return model
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    kept = sample.mapInArrow(count, "key string, toxic long, clean long")
    kept = kept.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = kept.filter((F.col("toxic") >= LEAST_DOCS) & (ratio > LEAST_RATIO)).select("key").toPandas()
    keys = sorted(kept["key"])
    wanted = {k: i for i, k in enumerate(keys)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("words").to_pylist()
            found = [sorted({wanted[x] for w in t.split(" ") if w for x in _keys(w) if x in wanted}) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("y")], ["hits", "y"])

    rows: pd.DataFrame = sample.mapInArrow(hits, "hits array<int>, y int").toPandas()
    discard(sample)
    w, bias = fit_weights([np.asarray(x, int) for x in rows["hits"]], rows["y"].to_numpy(float), len(keys))
    return model | {"keys": keys, "w": w, "bias": min(bias, prior)}


def fit_weights(hits: list[np.ndarray], y: np.ndarray, width: int, ridge: float = 0.5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with weights of at least 0: a clean word never hides a toxic one."""
    doc = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.concatenate([*hits, np.zeros(0, int)]).astype(int)
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
    w, b, m, v = np.full(width, 1.0), -1.0, np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[col], len(hits)), -30, 30)))
        e = (p - y) * weight
        g = np.r_[np.bincount(col, e[doc], width) + ridge * w, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for each row of docs.

    Null and empty texts hold no feature and get the model's base score; so does every text if no toxic row was learned.
    Texts are read whole and tokens decoded whole, whatever their length. Repeated rows are scored alike, rows without an id
    count as held out, an empty table gives no rows, and other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            raw = np.array([score(data[at[k] : at[k + 1]].tobytes()) for k in range(batch.num_rows)])
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-raw)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject (same rules as score_toxicity)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            data, at = text_bytes(batch.column(at_text))
            raw = np.array([score(data[at[k] : at[k + 1]].tobytes()) for k in range(batch.num_rows)])
            yield batch.filter(pa.array(raw < 0))

    plain = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])  # names may hold any character
    kept = plain.mapInArrow(run, plain.schema)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
