"""Token counts of a byte-fallback BPE vocabulary, by a whole-token shortcut.

Two facts are proved once from the vocabulary, before any text is read:

1. Where no piece holds two characters side by side, no merge ever crosses between them. Texts are cut there into
   pre-tokens whose merges are independent.
2. A piece is whole if the merges of its own characters end in that piece alone. A pre-token that is whole is one token,
   and so is a single character with a piece of its own; a character without one is a token for each UTF-8 byte.

Only what is left is merged, once for each different pre-token that a worker remembers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

SPACE = "▁"  # stands for a space, also before the first character
PIECE = 1 << 20  # characters that are cut at once
SHORT = 24  # characters up to which pairs are searched one by one
REMEMBERED, REMEMBERED_LENGTH = 1 << 19, 64  # merged pre-tokens that a worker keeps, and their longest


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores that merges can make: all but control, unknown and byte pieces. ValueError for another kind of model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if m.encode("  a  b", out_type=str)[-1] != SPACE + "b" or m.encode("") or not m.is_byte(m.piece_to_id("<0x00>")):
        raise ValueError("the model must keep white space as it is, put a space first and fall back to bytes")
    ids = [k for k in range(m.vocab_size()) if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k))]
    if any(m.is_unused(k) for k in ids):
        raise ValueError("models with unused pieces are not supported")
    return {m.id_to_piece(k): m.get_score(k) for k in ids}


class Vocabulary:
    """Tables that follow from the pieces. `whole` is the proved set where it is known already."""

    def __init__(self, pieces: dict[str, float], whole: frozenset[str] | None = None):
        self.rank = {p: -score for p, score in pieces.items()}
        chars = sorted({c for p in pieces for c in p})
        place = {c: k for k, c in enumerate(chars, 1)}
        self.place = np.zeros(0x110000, np.uint16)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.joins[[place[a] for a, _ in pairs], [place[b] for _, b in pairs]] = True
        self.cost = np.ones(0x110000, np.uint8)  # tokens of a character that stands alone
        for k, first in enumerate((0x80, 0x800, 0x10000), 2):
            self.cost[first:] = k
        self.cost[[ord(c) for c in chars if c in pieces]] = 1
        self.whole = frozenset(p for p in pieces if self.merged(p) == 1) if whole is None else whole
        self.known = dict.fromkeys(self.whole, 1)

    def _ends(self, parts: list[str]) -> int:
        return sum(1 if p in self.rank else len(p.encode()) for p in parts)

    def merged(self, text: str) -> int:
        """Tokens of a pre-token: the best-scored neighbours merge first, then the leftmost."""
        return self._merged_short(text) if len(text) <= SHORT else self._merged_long(text)

    def _merged_short(self, text: str) -> int:
        get, none = self.rank.get, float("inf")
        parts = list(text)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
        return self._ends(parts)

    def _merged_long(self, text: str) -> int:
        """The same with a heap over a linked list, for texts without an end to a word: n log n."""
        get, parts = self.rank.get, list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = right[k]
            if not parts[k] or j < 0 or len(parts[k]) + len(parts[j]) != len(pair) or parts[k] + parts[j] != pair:
                continue
            parts[k], parts[j] = pair, ""
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for a in (left[k], k):
                b = right[a] if a >= 0 else -1
                if b >= 0 and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return self._ends([p for p in parts if p])

    def pretoken_counts(self, found: list[str]) -> list[int]:
        get = self.known.get
        counts = [get(x, 0) for x in found]
        if not all(counts):
            for k, n in enumerate(counts):
                if not n:
                    n = get(found[k], 0) or self.merged(found[k])  # remembered since
                    counts[k] = n
                    if len(found[k]) <= REMEMBERED_LENGTH:
                        if len(self.known) >= REMEMBERED:
                            self.known = dict.fromkeys(self.whole, 1)
                            get = self.known.get
                        self.known[found[k]] = n
        return counts

    def _cut(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and where each pre-token starts; rows start at `starts`."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = self.place[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joins[at[:-1], at[1:]]
        cut[starts] = True
        return points, np.flatnonzero(cut)

    def _add(self, total: np.ndarray, row: int, text: str, starts: np.ndarray, keep_last: bool = False) -> str:
        """Add the tokens of rows row, row + 1 and so on; with keep_last, the last pre-token is given back uncounted."""
        points, first = self._cut(text, starts)
        end = np.r_[first[1:], len(points)]
        tail = ""
        if keep_last:
            tail = text[first[-1] :]
            first, end = first[:-1], end[:-1]
        own = np.searchsorted(starts, first, "right") - 1 + row
        single = end - first == 1
        np.add.at(total, own[single], self.cost[points[first[single]]].astype(np.int64))
        many = ~single
        counts = self.pretoken_counts([text[a:b] for a, b in zip(first[many].tolist(), end[many].tolist(), strict=True)])
        np.add.at(total, own[many], np.array(counts, np.int64))
        return tail

    def counts(self, texts: Iterator[str], n: int) -> np.ndarray:
        """Tokens of n texts; short ones are cut together, a long one in parts that end between pre-tokens."""
        total = np.zeros(n, np.int64)
        held: list[str] = []
        size = first = 0

        def flush() -> None:
            lengths = np.array([len(x) for x in held])
            some = np.flatnonzero(lengths)
            if len(some):
                part = np.zeros(len(some), np.int64)
                self._add(part, 0, "".join(held), np.r_[0, np.cumsum(lengths[some])[:-1]])
                total[first + some] = part

        for k, text in enumerate(texts):
            text = SPACE + text.replace(" ", SPACE) if text else ""
            if len(text) > PIECE:
                tail = ""
                for at in range(0, len(text), PIECE):
                    tail = self._add(total, k, tail + text[at : at + PIECE], np.zeros(1, int), keep_last=at + PIECE < len(text))
                text = ""
            held.append(text)
            size += len(text)
            if size >= PIECE:
                flush()
                held, size, first = [], 0, k + 1
        flush()
        return total


@lru_cache(maxsize=2)
def _vocabulary(pieces: tuple[tuple[str, float], ...], whole: frozenset[str]) -> Vocabulary:
    """A worker's tables, kept from task to task."""
    return Vocabulary(dict(pieces), whole)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of docs.

    Tokens are those that the model's own library gives without begin and end tokens; strings of special tokens in a text are
    plain text. Null counts as empty; empty texts have none. Texts of any length are read whole, repeated rows are counted
    alike, a null id stays null, an empty table gives no rows, and other columns of docs are ignored. What is broadcast is the
    vocabulary, whatever the texts' size. Nothing is shuffled.
    """
    pieces = load_pieces(model_path)
    proved = Vocabulary(pieces).whole
    sent = docs.sparkSession.sparkContext.broadcast((tuple(pieces.items()), proved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(*sent.value)
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            texts = (data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True))
            n = vocabulary.counts(texts, batch.num_rows)
            arrays = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
