"""Token counts, divergence and spelling variants against the tokenizer's library and plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tarnloom.llm import divergence, queries, spelling, tokens
from tarnloom.llm.common import table
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = ("h", "n", "word", "near", "term", "place", "total", "run", "id", "e", "x", "a", "b", "rank", "n_tokens", "a.b")
ODD = [
    (None, None, None, None), (None, "no id here", "en", None), (None, "no id here", "en", None), (7, "", None, "s"), (8, " \n\t ", "en", "s"),
    (9, "ÄÖÜ ÀÉ× Straße STRASSE İstanbul", "de", "s"), (9, "ÄÖÜ ÀÉ× Straße STRASSE İstanbul", "de", "s"), (10, "x" * 70_000, "en", "t"), (11, "word " * 50_000, "en", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    more = docs.union(spark.createDataFrame(ODD, docs.schema))
    return more.withColumns({c: F.lit(1) for c in CLASH}).repartition(5).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary(tokens.load_pieces(MODEL))


def test_counts_are_the_librarys(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(str, tokens.count_tokens(odd, MODEL).collect()))
    want = []
    for r in odd.select("doc_id", "text").collect():
        n = len(library.encode(r["text"] or ""))
        want.append(f"Row(doc_id={r['doc_id']}, n_bytes={len((r['text'] or '').encode())}, n_tokens={n}, over_limit={n > 4096})")
    assert got == sorted(want)
    assert tokens.count_tokens(odd.limit(0), MODEL).count() == 0


def test_counts_of_mixed_scripts_and_long_texts(vocabulary, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(1)
    pool = [" ", "  ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "😀", "\0", "▁", "<s>", "</s>", "<0x41>", "1", "23", ".", "...", "--", "(", "́", "ﬁ", "�", "\U0010ffff", "Ω", "ไทย", "한국", "=="]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(4000)] + ["", " ", "abcdefghij" * 500, " " * 3000]
    assert vocabulary.counts(iter(texts), len(texts)).tolist() == [len(library.encode(x)) for x in texts]
    monkeypatch.setattr(tokens, "PIECE", 40)  # parts of long texts end between pre-tokens
    monkeypatch.setattr(tokens, "REMEMBERED", len(vocabulary.whole) + 5)
    some = ["".join(texts[k : k + 9]) for k in range(0, 900, 9)] + ["abcdefghij" * 500]
    assert vocabulary.counts(iter(some), len(some)).tolist() == [len(library.encode(x)) for x in some]


def test_whole_pieces_are_proved(vocabulary):
    assert {p for p in vocabulary.rank if vocabulary.merged(p) == 1} == vocabulary.whole and len(vocabulary.whole) > 30_000
    small = tokens.Vocabulary({"a": -1.0, "b": -2.0, "c": -3.0, "ab": -4.0, "bc": -3.5, "abc": -6.0})
    assert small.whole == {"a", "b", "c", "ab", "bc", "abc"}  # bc merges first, then a with bc
    small = tokens.Vocabulary({"a": -1.0, "b": -2.0, "c": -3.0, "d": -3.1, "ab": -4.0, "bc": -3.5, "abd": -6.0, "abcd": -7.0})
    assert "abcd" not in small.whole and small.merged("abcd") == 3  # a, bc, d: no piece joins them
    for draw in range(200):
        text = "".join(random.Random(draw).choices("theing rao.", k=60)).replace(" ", tokens.SPACE)
        assert vocabulary._merged_short(text) == vocabulary._merged_long(text)


def _plain_divergence(docs, least, most):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    seen, count, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        seen.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        terms = [w for (x, w), n in seen.items() if x == lang and n >= least]
        share = lambda c: {w: 1 + (10**9 * (c[w] + 5)) // (sum(c.values()) + 5 * len(terms)) for w in terms}  # noqa: B023, E731
        own = {s: {w: count[lang, s, w] for w in terms} for s in sources}
        p, q = {s: share(c) for s, c in own.items()}, share({w: sum(c[w] for c in own.values()) for w in terms})
        for s in sources:
            pair = sorted((-sum(abs(p[s][w] - p[o][w]) for w in terms), o.encode()) for o in sources if o != s)
            term = sorted((q[w] - p[s][w], w.encode()) for w in terms if own[s][w] and p[s][w] > q[w])[:most]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, most", [(30, 50), (2, 3), (10**6, 50)])
def test_divergence_equals_a_plain_version(spark, odd, least, most):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    got = divergence.divergence(odd, least, most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == _plain_divergence(docs, least, most)


def test_divergence_of_texts_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 40)
    monkeypatch.setattr(divergence, "MOST_HELD", 30)
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect() if len(r["text"] or "") < 5000]
    got = divergence.divergence(spark.createDataFrame(docs, odd.select("doc_id", "text", "lang", "source").schema), 3, 5)
    assert sorted(tuple(r) for r in got.collect()) == _plain_divergence(docs, 3, 5)


def test_divergence_of_nothing(spark, odd):
    assert divergence.divergence(odd.limit(0)).count() == 0
    assert divergence.divergence(odd.filter("lang is null and text is null")).count() == 0  # one source: no pair


def test_shares_are_exact_for_large_counts(spark):
    draw = random.Random(3)
    cases = [(n := draw.randrange(10**k), n + draw.randrange(10**k), draw.randrange(1, 10**6)) for k in range(1, 16) for _ in range(20)]
    frame = spark.createDataFrame(cases, "c long, total long, v long")
    got = frame.select("c", "total", "v", divergence.share(F.col("c"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["total"] + 5 * r["v"]) for r in got)


def _plain_words(docs, length, least):
    n = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= length
    return {w: k for w, k in n.items() if k >= least}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain_variants(words):
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words.get(form.get(w), 0)) for w, n in words.items())


def _found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_variants_equal_a_plain_version(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    words = _plain_words(docs, 6, 5)
    assert _found(spelling.group_variants(odd)) == _plain_variants(words)
    assert spelling.group_variants(odd.limit(0)).count() == 0


def test_variants_of_crowded_words(spark):
    """Few letters, so words have many neighbours, ties and chains of forms; the bitmap is full."""
    draw = random.Random(8)
    docs = [(k, " ".join("".join(draw.choices("abé", weights=(8, 2, 1), k=draw.randrange(2, 7))) for _ in range(200))) for k in range(60)] + [(60, "aaaa " * 5000), (61, None), (61, "bbbbb " * 30 + "bbbbbb " * 300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    words = _plain_words(docs, 3, 2)
    assert len(words) > 200 and _found(spelling.group_variants(frame, least_length=3, least_count=2)) == _plain_variants(words)
    listed = spark.createDataFrame(list(words.items()), "word string, n long")
    few = sorted(map(tuple, spelling.near_words(listed, max_bits=1 << 16).select("word", "near").collect()))
    assert few == sorted((a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and _one_edit(a, b))


def test_a_neighbourhood_is_complete_and_without_repeats():
    alphabet = np.array([ord(c) for c in "abc"], np.uint32)
    for word in ("a", "ab", "aab", "abba", "cccc", "abcabc"):
        points = np.array([[ord(c) for c in word]], np.uint32)
        for step in (1 << 20, 4):
            spelling.CANDIDATES, before = step, spelling.CANDIDATES
            got = ["".join(map(chr, x)) for _, out in spelling.neighbours(points, alphabet, lambda h: np.ones(h.shape, bool)) for x in out]
            spelling.CANDIDATES = before
            n = len(word)
            want = {word[:k] + word[k + 1 :] for k in range(n)} | {word[:k] + c + word[k + 1 :] for k in range(n) for c in "abc" if c != word[k]}
            want |= {word[:k] + c + word[k:] for k in range(n + 1) for c in "abc"}
            assert len(got) == len(set(got)) and set(got) == want
        hashes = []
        for _, out in spelling.neighbours(points, alphabet, lambda h: hashes.extend(h.ravel().tolist()) or np.ones(h.shape, bool)):
            assert set(spelling.word_hashes(out).tolist()) <= set(hashes)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_spelling_variants"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
