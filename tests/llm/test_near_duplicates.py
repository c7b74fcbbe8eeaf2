"""Near duplicates and components against brute force, with odd inputs and large groups."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnloom.llm import embeddings, minhash
from tarnloom.llm.graph import connected_components


def components(ids, links):
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_odd_graphs(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    want = components({v for e in edges if e[0] != e[1] for v in e}, edges)
    frame = spark.createDataFrame([*edges, *edges[:5], (5, None), (None, 7), (9, 9)], "a long, b long")
    assert {r["id"]: r["component"] for r in connected_components(frame).collect()} == want
    assert connected_components(frame.limit(0)).count() == 0


def _texts():
    """Groups of near copies, one of them larger than a block, beside plain texts and odd ones."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    rows = {}
    for g in range(25):
        base = rng.choices(vocab, k=rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows[len(rows)] = " ".join(t)
    base = rng.choices(vocab, k=200)
    for k in range(620):
        t = list(base)
        for _ in range(k % 14):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows[len(rows)] = " ".join(t)
    for t in (None, "", " \t\n", "one", "ONE", "one two", "One\ttwo", "é é", "é É", " ".join(base) + "  ", " ".join(base).upper()):
        rows[len(rows)] = t
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_documents_match_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 100)
    monkeypatch.setattr(minhash, "NODE_LIMIT", 40)
    rows = _texts()
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(rows, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(rows, links)
    frame = spark.createDataFrame([(i, t, "clash", b"x") for i, t in rows.items()], "doc_id long, text string, component_id string, sig binary")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame, words=words).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_odd_rows_of_documents(spark):
    rows = [(1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, "a b c d"), (None, "a b c d"), (None, None), (7, "q r s"), (7, "q r s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(frame, words=2).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("None", "None", True), ("None", "None", True), ("7", "7", True), ("7", "7", True)])
    kept = minhash.deduplicated(frame, words=2)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "7", "None", "None"] and kept.columns == frame.columns
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    """400 pairs with a similarity of exactly 0.8 among unrelated texts; 150 of them share most of their words with a crowd."""
    rng = random.Random(11)
    crowd = [f"c{k}" for k in range(91)]
    rows, pairs = [], []
    for k in range(400):
        base = [f"v{rng.randrange(100_000)}" for _ in range(91)]
        if k < 150:
            base[:60] = crowd[:60]
        other = list(base)
        for at in range(61, 91, 6):  # five words apart from each other: 80 shingles of 90 stay, 100 are in the union
            other[at] = f"x{k}-{at}"
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows) + k, " ".join(f"v{rng.randrange(100_000)}" for _ in range(91))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, words=2).collect()}
    missed = sum(got[a] != got[b] for a, b in pairs)
    assert missed <= 2 and sum(got[i] != i for i, _ in rows) == len(pairs) - missed


def test_deduplication_keeps_odd_columns(spark):
    rows = [(1, "a b c", 7, {"k": "v"}, "x", 0.5), (1, "a b c", 7, {"k": "w"}, "x", 0.5), (2, "a b c", None, None, None, None), (None, None, 1, {}, "y", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h int, row map<string,string>, `a.b` string, component double")
    got = minhash.deduplicated(frame, words=2)
    assert got.dtypes == frame.dtypes
    assert sorted((str(r["doc_id"]), r["h"]) for r in got.collect()) == [("1", 7), ("None", 1)]
    assert minhash.deduplicated(frame.limit(0), words=2).count() == 0


def _vectors(n_groups=12, hot=300):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(n_groups):
        base = rng.normal(size=16)
        for _ in range(6):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15])).tolist(), g % 3))
    base = rng.normal(size=16)
    for _ in range(hot):
        rows.append((len(rows), (base + rng.normal(size=16) * 0.1).tolist(), 0))
    same = rng.normal(size=16).tolist()
    rows += [(len(rows) + k, same, 1) for k in range(40)]
    n = len(rows)
    return rows + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [float("inf")] + [1.0] * 15, 0), (n + 4, same, None), (n + 5, [None] + [1.0] * 15, 0), (n + 6, [], 0), (n + 7, [2 * x for x in same], 1), (n + 8, same[:8], 1)]


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rows = _vectors()
    ok = {i: (np.array(v, float) / np.linalg.norm(np.array(v, float)), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98]
    want = components([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    frame = spark.createDataFrame([(i, v, y, 1.0) for i, v, y in rows], "vec_id long, embedding array<double>, label int, id double")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(frame).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == degree
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert embeddings.near_vectors(frame.limit(0)).count() == 0
    nothing = embeddings.near_vectors(spark.createDataFrame([(1, None, 2), (None, [1.0], 2)], "vec_id long, embedding array<double>, label int")).collect()
    assert len(nothing) == 2 and all(r["n_links"] == 0 and r["kept"] for r in nothing)


def test_float_vectors_match_the_same_doubles(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40] + np.float32(0.02) * rng.standard_normal(6).astype(np.float32)], i % 2) for i in range(400)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = wide.withColumn("embedding", F.col("embedding").cast("array<float>").cast("array<double>"))
    narrow = wide.withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = sorted(embeddings.near_vectors(narrow).collect())
    assert got == sorted(embeddings.near_vectors(wide).collect()) and any(r["n_links"] for r in got)
    vectors = {r["vec_id"]: (np.array(r["embedding"]), r["label"]) for r in wide.collect()}
    for r in got:
        x, label = vectors[r["vec_id"]]
        links = [i for i, (y, z) in vectors.items() if i != r["vec_id"] and z == label and x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y))]
        assert r["n_links"] == len(links)
