"""Fingerprints, packing, mixing, archives and the pipeline against plain versions."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnloom.llm import fingerprint, mixing, packing, queries, secrets, toxicity, warc
from tarnloom.llm.common import table
from tests.llm.test_learned import _plain_markov, _plain_spans

SF = "/root/testdata/sf0.001"


def test_peeling_recovers_differences():
    rng = np.random.default_rng(4)
    a, b = [], []
    for k in range(40):
        shared, left, right = rng.integers(0, 1 << 63, 30, np.uint64), rng.integers(0, 1 << 63, k, np.uint64), rng.integers(0, 1 << 63, k // 3, np.uint64)
        a.append(np.unique(np.r_[shared, left]))
        b.append(np.unique(np.r_[shared, right]))
    a += [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    b += [np.zeros(0, np.uint64), np.array([7], np.uint64)]
    want = [len(np.intersect1d(x, y)) / len(np.union1d(x, y)) if len(x) or len(y) else 1.0 for x, y in zip(a, b, strict=True)]
    assert np.allclose(fingerprint.likeness(a, b), want)


def test_written_fingerprints_give_back_their_differences():
    rng = np.random.default_rng(12)
    came = 0
    for k in range(60):
        both, left, right = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (20, k % 6, k % 4))
        a, b = fingerprint.written([np.union1d(both, left), np.union1d(both, right)])
        got = fingerprint.written_difference(a, b)
        came += got is not None
        assert got is None or got == (left.tolist(), right.tolist())
    assert came > 50 and fingerprint.written_difference(a, a) == ([], [])


def test_digests_follow_the_paragraphs():
    import xxhash

    assert set(fingerprint.digests(b"one. two!  three\r\n\nfour.five").tolist()) == {xxhash.xxh64_intdigest(x) for x in (b"one.", b"two!", b"three", b"four.five")}


def test_edits_of_rows_that_change_their_order(spark):
    """Every job reads the rows in an order of its own."""
    rows = [(k, f"text {k}. second {k % 5}. third") for k in range(80)] + [(7, "twice"), (7, "twice")] + [(None, "no id"), (None, "no id"), (90, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stable = sorted(map(str, fingerprint.fingerprint_edits(frame.coalesce(1)).select("doc_id", "n_chars", "edited_sha256").collect()))
    for _ in range(3):
        moving = frame.withColumn("r", F.uuid()).repartition(5, "r").sortWithinPartitions("r").drop("r")
        assert sorted(map(str, fingerprint.fingerprint_edits(moving).select("doc_id", "n_chars", "edited_sha256").collect())) == stable


def test_ranges_split_equal_rows(spark):
    rows = [(None, "same text. twice")] * 300 + [(k, f"text {k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.lit(5).cast("long").alias("h"), F.monotonically_increasing_id().alias("salt"))
    keyed = frame.withColumn("key", key)
    cuts = fingerprint.range_cuts(keyed, 9)
    got = keyed.withColumn("part", fingerprint.range_of(cuts)).collect()
    assert len(cuts) == 8 and all(r["part"] == sum(c > tuple(r["key"]) for c in cuts) for r in got)
    sizes = np.bincount([r["part"] for r in got], minlength=9)
    assert sizes.max() < 90 and sizes.min() > 10
    plain = _plain_edits([(i, t, 0) for i, t in rows])
    out = fingerprint.fingerprint_edits(frame).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out], key=str) == plain


def _plain_edits(rows):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2])
    rows = sorted(rows, key=key, reverse=True)
    out = []
    for k, (i, t, _) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        sets = [set(fingerprint.digests(x.encode()).tolist()) for x in (t, edited, nxt)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like[0], 9), round(like[1], 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["table", "odd", "one"])
def test_fingerprints_match_plain_edits(spark, kind):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = [(5, "a. b. c"), (5, "other\nlines"), (None, "no id. here"), (None, None), (9, ""), (3, "é😀" * 50), (4, "x" * 200_000), (2, None), (2, None)]
    if kind != "table":
        docs = spark.createDataFrame(odd[: 1 if kind == "one" else None], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"], r["h"]) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    got = fingerprint.fingerprint_edits(docs.withColumn("part", F.lit("clash"))).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == _plain_edits(rows)
    by_text = {}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if kind == "table":
            mine = set(fingerprint.digests((texts[r["doc_id"]] or "").encode()).view(np.int64).tolist())
            assert set(r["removed"]) <= mine and not set(r["added"]) & mine
            assert abs(r["near_edited"] - ((len(mine) - len(r["removed"])) / (len(mine) + len(r["added"])) if mine or r["added"] else 1)) < 1e-9
            assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert fingerprint.fingerprint_edits(docs.limit(0)).count() == 0


def test_best_fit_places_everything_once():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 1025, 800)
    which, offset, size, used = packing.best_fit(lengths, (128, 256, 1024), 16)
    assert (np.bincount(which, lengths) == used).all() and (used <= size).all() and set(size) <= {128, 256, 1024}
    for b in range(len(size)):
        mine = np.flatnonzero(which == b)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.r_[0, np.cumsum(lengths[mine])[:-1]]).all()
        assert not any(used[b] <= s < size[b] for s in (128, 256, 1024))
    assert used.sum() / size.sum() > 0.95


def test_best_fit_matches_a_plain_version():
    rng = random.Random(8)
    for _ in range(30):
        sizes = (8, 16, 32)
        lengths = [rng.randrange(1, 33) for _ in range(40)]
        order = sorted(range(40), key=lambda k: -lengths[k])
        bins = []  # [room, contents]
        for place, k in enumerate(order):
            n = lengths[k]
            fit = sorted({b[0] for b in bins if b[0] >= n})
            if fit:
                target = [b for b in bins if b[0] == fit[0]]
                assert target
                chosen = max(target, key=lambda b: b[2])
            else:
                best = None
                for c in sizes:
                    if c >= n:
                        later = [lengths[j] for j in order[place + 1 :] if lengths[j] <= c - n]
                        cost = (c + 4) / min(c, n + sum(later))
                        if best is None or cost < best[0] - 1e-12:
                            best = (cost, c)
                chosen = [best[1], 0, 0]
                bins.append(chosen)
            chosen[0] -= n
            chosen[1] += n
            chosen[2] = place + 1
        _, _, size, used = packing.best_fit(np.array(lengths), sizes, 4)
        assert sorted(used.tolist()) == sorted(b[1] for b in bins)


def test_packing_keeps_every_token(spark):
    rows = [(k, "w " * n) for k, n in enumerate([0, 1, 700, 8192, 8193, 30_000, 5, 5])] + [(6, "w " * 5), (None, "a b"), (None, None), (50, " x y")]
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, bin int")
    got = packing.pack(frame, shard_rows=4).toPandas()
    words = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for _, t in rows]
    assert got.n_tokens.sum() == sum(words) and (got.n_tokens == 0).sum() == words.count(0)
    assert got[got.n_tokens == 0].bin.isna().all()
    real = got[got.n_tokens > 0]
    for _, g in real.groupby(["shard", "bin"]):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.n_tokens)[:-1]]).all() and g.n_tokens.sum() == g.bin_used.iloc[0] <= g.bin_size.iloc[0]
    long = got[got.doc_id == 5].sort_values("piece")
    assert list(long.start) == [0, 8192, 16384, 24576] and long.n_tokens.sum() == 30_000
    assert packing.pack(frame.limit(0)).count() == 0


def _pour(budget, children):
    """Plain water filling by bisection of the level: everyone has min(capacity, level * weight); odd tokens by name."""
    live = {k: (c, w) for k, (c, w) in children.items() if w > 0}
    got = dict.fromkeys(children, 0)
    if sum(c for c, _ in live.values()) <= budget:
        return got | {k: c for k, (c, _) in live.items()}
    low, high = Fraction(0), Fraction(max(c for c, _ in live.values()) + 1)
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(Fraction(c), level * w) for c, w in live.values()) > budget:
            high = level
        else:
            low = level
    full = {k for k, (c, w) in live.items() if c <= high * w}
    left, total = budget - sum(live[k][0] for k in full), sum(w for k, (_, w) in live.items() if k not in full)
    got |= {k: c if k in full else left * w // total for k, (c, w) in live.items()}
    for k in sorted(live.keys() - full)[: budget - sum(got.values())]:
        got[k] += 1
    return got


def _plain_budgets(leaves, weights, default, budget, epochs, depth=0):
    """Budgets of leaves {path: tokens}: what lies below a weight of 0 has no capacity."""
    w = lambda path: [weights[d].get(n, default) for d, n in enumerate(path)]
    if depth == len(weights):
        return dict.fromkeys(leaves, budget)
    children = {}
    for path, tokens in leaves.items():
        children.setdefault(path[depth], {})[path] = tokens
    cap = {n: sum(t * epochs for p, t in some.items() if min(w(p)) > 0) for n, some in children.items()}
    poured = _pour(budget, {n: (cap[n], weights[depth].get(n, default) if cap[n] else 0) for n in children})
    return {k: v for n, some in children.items() for k, v in _plain_budgets(some, weights, default, poured[n], epochs, depth + 1).items()}


def test_budgets_match_plain_water_filling(spark):
    rng = random.Random(9)
    weights = [{"a": 3, "b": 1}, {"x": 5, "y": 0, "z": 2}, {"1": 0, "2": 4, "3": 1}]
    cases = [({("a", "q", "1"): 900, ("a", "q", "2"): 100, ("b", "q", "2"): 1000}, 1, 1000)]
    for case in range(6):
        leaves = {(d, l, s): rng.randrange(1, 2000) for d in "ab" for l in "xyz"[: rng.randrange(1, 4)] for s in "1234"[: rng.randrange(1, 5)]}
        cases.append((leaves, 2, int(sum(leaves.values()) * (0.2 + 0.3 * case))))
    for leaves, epochs, total in cases:
        frame = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "d string, l string, s string, tokens long")
        got = mixing.budgets(frame, ["d", "l", "s"], weights, 2, F.lit(total), epochs)
        got = {(r["d"], r["l"], r["s"]): r["alloc"] for r in got.collect()}
        assert got == _plain_budgets(leaves, weights, 2, total, epochs)
        fits = sum(t * epochs for p, t in leaves.items() if p[1] != "y" and p[2] != "1")
        assert sum(got.values()) == min(total, fits)


@pytest.mark.parametrize("slice_rows", [4096, 3])
def test_mixing_matches_its_sql_with_a_zero_weight(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    odd = [(1, "p q r", "en", "src1")] * 9 + [(None, "n n", "de", "src2")] * 7 + [(None, None, None, None), (5, "", "en", "src1"), (None, "m", None, "odd")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    weights = [{"web": 300, "books": 0}, {"en": 400, "de": 50}, {"src0": 0, "src1": 700, "src2": 7}]
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(queries._mixing_sql(*weights)).fetchall()
    got = mixing.mix(docs, queries.source_tree(), weights).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 50


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a b c", None, None), (2, None, "en", "src1"), (3, "", "en", "src1"), (4, "x " * 5000, "en", "src1"), (5, "p q", "en", "src1"), (5, "p q", "en", "src1"), (None, "n n", "de", "odd"), (None, "m", "de", "odd")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    got = mixing.mix(frame, queries.source_tree(), [queries.DOMAIN_WEIGHTS, queries.LANG_WEIGHTS, queries.SOURCE_WEIGHTS])
    total = sum(len((r[1] or "").split()) for r in rows)
    assert got.agg(F.sum("taken")).first()[0] in range(total * 4 // 5 - 6, total * 4 // 5 + 1)
    assert got.filter("taken <= 0 or taken > n_tokens").count() == 0
    assert mixing.mix(frame.limit(0), queries.source_tree(), [{}, {}, {}]).count() == 0


def test_archives_round_trip(spark):
    big, tricky = "é" * 800, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, tricky), (4, "http://d/\r\nX: y", tricky), (4, "http://d/", tricky), (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (None, "u", big), (9, "u", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted([tuple(r) for r in warc.round_trip(frame).collect()], key=str)
    want, seen = [], {}
    for i, _, t in rows:
        raw = (t or "").encode()
        seen.setdefault(raw, []).append(i)
    for raw, ids in seen.items():
        order = sorted(ids, key=lambda x: (x is not None, x or 0))
        for k, i in enumerate(order):
            first = len(raw) < 1000 or k == len(order) - 1
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else order[-1]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archives_in_gzip_members_and_broken_ones():
    one = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    lost = one.replace(b"Content-Length: 3\r\n", b"")
    zipped = gzip.compress(one)
    for raw in (one * 2, zipped + zipped, gzip.compress(one * 2), zipped + b"\0" * 9 + zipped):
        assert [(b, e) for _, b, e in warc.parse(memoryview(raw))] == [(b"abc", None)] * 2
    for raw, want in {
        one[:-6]: ["truncated record"],
        b"no record": ["no WARC record"],
        one + lost + one: [None, "no Content-Length", None],
        b"junk\r\n" + one: ["no WARC record", None],
        zipped + zipped[:12] + b"\x07" * 30 + zipped: [None, None, "gzip"],
        zipped + zipped[:-12]: [None, "truncated record", "gzip"],
        b"": [],
    }.items():
        got = [(e or "").split(" member")[0] or None for _, _, e in warc.parse(memoryview(raw))]
        assert got == want, (raw, got)


def test_archives_are_cut_by_bytes_with_a_member_a_record(spark, tmp_path):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 126)) for _ in range(9_000_000))
    pages = [(k, "http://u/", noise[k : k + 60_000]) for k in range(40)] + [(50, "http://u/", noise), (51, "http://u/", noise * 2)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, f"file://{tmp_path}/w", file_bytes=1 << 20)
    files = sorted(str(x) for x in (tmp_path / "w").glob("part-*"))
    records = []
    for f in files:
        raw = open(f, "rb").read()
        plain, rest, count = b"", raw, 0
        while rest:
            member = zlib.decompressobj(31)
            plain, rest, count = plain + member.decompress(rest), member.unused_data, count + 1
        found = list(warc.parse(memoryview(raw)))
        assert all(e is None for _, _, e in found) and plain.count(b"WARC/1.1\r\n") == len(found) <= count
        assert found[0][0][b"warc-type"] == "warcinfo"
        records += [h[b"warc-type"] for h, _, _ in found[1:]]
    assert len(files) > 2 and records.count("response") == 42 and records.count("request") == records.count("metadata") == 42
    again = {r["page_id"]: r["payload_digest"] for r in warc.round_trip(frame).collect()}
    assert again == {i: hashlib.sha1(t.encode()).hexdigest() for i, _, t in pages}


def test_archives_of_another_writer(spark, tmp_path):
    def record(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"content-length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    first = record("warcinfo", "i", b"a: b\r\n") + record("request", "q1", b"GET /\r\n\r\n", "WARC-Concurrent-To: <r1>") + record("response", "r1", http + b"body\r\n\r\nmore")
    second = record("revisit", "r2", http, "WARC-Refers-To: <r1>") + record("metadata", "m1", b"k: v\r\n", "WARC-Concurrent-To: <r2>") + record("metadata", "m2", b"", "WARC-Concurrent-To: <r2>")
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "one.warc").write_bytes(first + b"WARC/1.0\r\nWARC-Type: request\r\n\r\n")
    (folder / "two.warc.gz").write_bytes(gzip.compress(second[:100]) + gzip.compress(second[100:]))
    rows = warc.read_archives(spark, f"file://{folder}").cache()
    assert sorted(r["error"] for r in rows.filter("error is not null").collect()) == ["no Content-Length"]
    got = {r["capture_id"]: r for r in warc.assemble(rows)[0].collect()}
    assert set(got) == {"<r1>", "<r2>"} and bytes(got["<r1>"]["captures"][0]["payload"]) == b"body\r\n\r\nmore"
    assert [m["record_id"] for m in got["<r2>"]["metadata"]] == ["<m1>", "<m2>"] and got["<r2>"]["captures"][0]["refers_to"] == "<r1>"


def _record_rows(spark, rows):
    return spark.createDataFrame([(k, i, c, None, None, None, None, None, None, {"a": "b"}, None, None) for k, i, c in rows], warc.RECORD)


def _ids(row, kind):
    return [x["record_id"] for x in row[kind]]


def test_assembly_drops_no_record(spark):
    rows = [("response", "r1", None), ("request", "q1", ["r1"]), ("metadata", "m1", ["r1"]), ("metadata", "m2", ["r1"]), ("request", "q9", ["gone"]), ("revisit", "v1", None), (None, None, None), ("warcinfo", "i", None)]
    rows += [("metadata", f"x{k:04}", ["v1"]) for k in range(1500)] + [("metadata", "x0000", ["v1"])] * 5
    frame = _record_rows(spark, rows).repartition(3)
    whole, beyond = warc.assemble(frame, most=10_000)
    got = {r["capture_id"]: r for r in whole.collect()}
    assert set(got) == {"r1", "gone", "v1"} and _ids(got["r1"], "metadata") == ["m1", "m2"] and _ids(got["gone"], "captures") == [] and beyond.count() == 0
    assert _ids(got["v1"], "metadata") == ["x0000"] * 6 + [f"x{k:04}" for k in range(1, 1500)] and _ids(got["v1"], "captures") == ["v1"]
    first, beyond = warc.assemble(frame)
    first = {r["capture_id"]: r for r in first.collect()}
    assert {k: r["n_records"] for k, r in first.items()} == {"r1": 4, "gone": 1, "v1": 1506}
    rest = [r["record"]["record_id"] for r in beyond.collect()]
    assert _ids(first["v1"], "captures") == ["v1"] and len(first["v1"]["metadata"]) == 999
    assert sorted(_ids(first["v1"], "metadata") + rest) == _ids(got["v1"], "metadata") and {r["kind"] for r in beyond.collect()} == {"metadata"}
    assert all(x.count() == 0 for x in warc.assemble(frame.limit(0)))


def test_transactions_by_chains_and_repeated_headers(spark):
    rows = [
        ("response", "r", None), ("request", "q", ["r"]), ("metadata", "m", ["q"]), ("metadata", "mm", ["m", "nowhere"]),  # a chain
        ("response", "a", ["ask"]), ("response", "b", None), ("request", "ask", None), ("metadata", "both", ["a", "b"]),  # named by its response; two targets
        ("metadata", "far", ["both", "q"]),  # leads to a, b and r: the least
        ("request", "o1", ["lost"]), ("metadata", "o2", ["o1"]), ("metadata", "o3", ["o2", "o1"]),  # no capture at all
        ("request", "c1", ["c2"]), ("metadata", "c2", ["c1"]),  # a ring
        ("metadata", None, ["r"]), ("request", "alone", None), ("response", "self", ["self"]),
    ]
    chain = [("metadata", "d000", ["r"])] + [("metadata", f"d{k:03}", [f"d{k - 1:03}"]) for k in range(1, 60)]
    got = {r["capture_id"]: r for r in warc.assemble(_record_rows(spark, rows + chain))[0].collect()}
    assert set(got) == {"r", "a", "b", "lost", "c1", "alone", "self"}
    assert _ids(got["r"], "requests") == ["q"] and _ids(got["r"], "metadata") == [None, *(f"d{k:03}" for k in range(60)), "m", "mm"]
    assert _ids(got["a"], "requests") == ["ask"] and _ids(got["a"], "metadata") == ["both", "far"] and _ids(got["b"], "metadata") == ["both"]
    assert _ids(got["lost"], "requests") == ["o1"] and _ids(got["lost"], "metadata") == ["o2", "o3"] and not got["lost"]["captures"]
    assert _ids(got["c1"], "requests") == ["c1"] and _ids(got["c1"], "metadata") == ["c2"] and _ids(got["self"], "captures") == ["self"]


def test_repeated_headers_are_all_read():
    raw = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <a>\r\nwarc-concurrent-to: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert warc._row(*next(iter(warc.parse(memoryview(raw)))))[2] == ["<a>", "<b>"]


def test_peeling_ends_on_forged_cells():
    key, other = np.array([12345], np.uint64), np.array([777], np.uint64)
    places = fingerprint._cells(np.zeros(1, np.int64), key, 15)[:, 0].tolist()
    for at in [k for k in range(15) if k not in places][:4] + places:
        t = fingerprint.Tables(2, 15)
        t.n[at], t.key[at], t.check[at] = 1, key[0], fingerprint._check(key)[0]  # a cell that only looks pure
        t.add(np.ones(1, np.int64), other)
        row, found, sign, done = t.peel()
        assert done.tolist() == [False, True] and (found[row == 1] == other).all() and len(found) < 40


def test_differences_end_where_every_size_fails(monkeypatch):
    monkeypatch.setattr(fingerprint.Tables, "peel", lambda t, mask=None: (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(t.rows, bool)))
    a, b = [np.array([1, 2, 3], np.uint64)], [np.array([3, 9], np.uint64)]
    left, right = fingerprint.differences(a, b)
    assert left[0].tolist() == [1, 2] and right[0].tolist() == [9]


def _plain_shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def _plain_survivors(rows):
    """Ids that stay: the smallest of each group linked by five-word shingles at 0.8."""
    sets = {i: _plain_shingles(t, 5) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(rows), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in rows if find(i) == i}


def _plain_mix(rows, spark):
    """Ids in each leaf's prefix: the plain budgets, and a running sum in the seeded order of epoch 0."""
    leaf, tokens = {}, {}
    for r in rows:
        n = len([w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
        if n:
            number = re.fullmatch(r"src(\d+)", r["source"] or "")
            domain = "unknown" if not number else "web" if int(number[1]) < 10 else "books"
            leaf.setdefault((domain, r["lang"] or "unknown", r["source"] or "unknown"), []).append((r["doc_id"], n))
    tokens = {p: sum(n for _, n in some) for p, some in leaf.items()}
    weights = [queries.DOMAIN_WEIGHTS, queries.LANG_WEIGHTS, queries.SOURCE_WEIGHTS]
    out = set()
    for p, budget in _plain_budgets(tokens, weights, 100, sum(tokens.values()) * 9 // 10, 1).items():
        at = 0
        for i, n in sorted(leaf[p], key=lambda x: hashlib.md5(f"11:{int(budget >= tokens[p]) and 0}:{x[0]}".encode()).hexdigest()):
            if at < budget:
                out.add(i)
            at += n
    return out


def test_pipeline_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = docs.collect()
        before, after = {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after)
        if name == "secrets":
            ratios = secrets.fit_ratios(secrets.corpus_samples(docs).union(secrets.rule_samples(docs)))
            assert after == {i: _plain_redaction(t, ratios) for i, t in before.items()}
        else:
            if name == "toxicity":
                score = toxicity.Scorer(toxicity.fit(docs, table(spark, SF, "labels")))
                want = {i for i, t in before.items() if score((t or "").encode()) < 0}
                assert len(want) < len(before)
            want = _plain_survivors(before) if name == "near_duplicates" else _plain_mix(rows, spark) if name == "mixing" else want
            assert set(after) == want and all(before[i] == t for i, t in after.items()), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    n = {r["doc_id"]: r["n"] for r in docs.select("doc_id", packing.words().alias("n")).collect()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == n
    assert (packed.groupby(["shard", "bin"]).n_tokens.sum() == packed.groupby(["shard", "bin"]).bin_used.first()).all()
    _, _, size, used = packing.best_fit(np.array([min(8192, m - k) for m in n.values() for k in range(0, m, 8192)]), packing.SIZES)
    bins = packed.dropna().groupby(["shard", "bin"])[["bin_used", "bin_size"]].first()
    assert sorted(bins.bin_used) == sorted(used) and sorted(bins.bin_size) == sorted(size)


def _plain_redaction(text, ratios):
    if not text:
        return text
    spans = [x.split(":")[1:] for x in _plain_spans(text) + _plain_markov(text, ratios)]
    at, out = 0, ""
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        out += text[at:a] + secrets.MASK if a >= at else ""
        at = max(at, b)
    return out + text[at:]
