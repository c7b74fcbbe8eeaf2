"""Properties and small fixtures of the base operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnloom.functions import scores as S
from tarnloom.functions import text as T
from tarnloom.operators import aggregates as A
from tarnloom.operators import filters as P
from tarnloom.operators import hierarchy as H
from tarnloom.operators import joins as J
from tarnloom.operators import ranking as R
from tarnloom.operators import scans
from tarnloom.operators import sampling as X
from tarnloom.plans import workflows as W
from tarnloom.sources import incremental, paged
from tarnloom.sources import sinks as K
from tarnloom.sources import tables as SJ
from tarnloom.sources import text_records as SR
from tarnloom.streaming import rollups

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_lower_tail_fixture(spark):
    s = F.array(*[F.lit(float(k)) for k in range(1, 11)])
    got = one(spark, S.lower_tail_mean(s, 0.1), S.lower_tail_mean(s, 0.5), S.lower_tail_mean(s, 1.0), S.lower_tail_mean(F.array(F.lit(4.0)), 0.01), S.lower_tail_mean(F.array().cast("array<double>"), 0.5))
    assert got[:4] == (1.0, 3.0, 5.5, 4.0) and math.isnan(got[4])


@few
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_lower_tail_properties(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None)], "g string, s double")
    r = A.tail_means(df, ["g"], "s", {"all": 1.0, "least": 1e-9, "half": 0.5, "tenth": 0.1}).first()
    assert math.isclose(r["all"], sum(values) / len(values), abs_tol=1e-9) and r["least"] == min(values) and r["least"] <= r["tenth"] <= r["half"] <= r["all"] + 1e-9


def test_pareto_fixture(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 2.0), (3, 3.0, 1.0), (4, 2.0, 2.0), (5, 1.0, 1.0), (6, None, 9.0)], "id int, x double, y double").withColumn("g", F.lit("a"))
    assert sorted(r["id"] for r in R.pareto_front(df, ["g"], "x", "y").collect()) == [1, 2, 3, 4]
    assert R.hypervolume(df, ["g"], "x", "y", (0.0, 0.0)).first()["hypervolume"] == 6.0


@few
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=30))
def test_pareto_matches_brute_force(spark, points):
    df = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(points)], "g string, id long, x double, y double")
    want = {k for k, p in enumerate(points) if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in points)}
    front = R.pareto_front(df, ["g"], "x", "y")
    assert {r["id"] for r in front.collect()} == want == {r["id"] for r in R.pareto_front(front, ["g"], "x", "y").collect()}
    area = R.hypervolume(df, ["g"], "x", "y", (0.0, 0.0)).first()["hypervolume"]
    assert area == sum(1 for x, y in itertools.product(range(8), repeat=2) if any(p[0] > x and p[1] > y for p in points))
    assert math.isclose(area, R.hypervolume(front, ["g"], "x", "y", (0.0, 0.0)).first()["hypervolume"])


def test_hot_groups_are_divided(spark):
    """One group of 400,000 distinct scores beside small ones, ties, nulls and a null group."""
    n = 400_000
    hot = spark.range(n).selectExpr("'hot' as g", "cast(hash(id) as double) + id / 1e6 as s", "cast(hash(id, 7) as double) as y")
    rest = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", None, 1.0), ("a", 0.5, 3.0), (None, 2.0, 2.0), (None, 4.0, 1.0), ("none", None, None)], "g string, s double, y double")
    df = hot.union(rest).cache()
    pdf, most = df.toPandas(), 1000
    h = np.sort(pdf[pdf.g == "hot"].s.to_numpy())
    tails = {r["g"]: (r["t1"], r["t5"]) for r in A.tail_means(df, ["g"], "s", {"t1": 0.1, "t5": 0.5}, most=most).collect()}
    assert np.allclose(tails["hot"], (h[: n // 10].mean(), h[: n // 2].mean()), rtol=1e-12) and tails["a"] == (0.5, 0.5) and tails[None] == (2.0, 2.0) and "none" not in tails
    got = {r["g"]: tuple(r)[1:] for r in A.summary(df, "g", "s", most=most).collect()}
    assert np.allclose(got["hot"], (n, h.mean(), np.median(h), h[0], h[-1])) and got["a"] == (3, 2.5 / 3, 1.0, 0.5, 1.0) and got["none"] == (0, None, None, None, None) and got[None][2] == 3.0
    known = df.filter("g is not null")
    front = {(r["g"], r["s"], r["y"]) for r in R.pareto_front(known, ["g"], "s", "y", most=most).collect()}
    points, best, want = pdf[(pdf.g == "hot")].sort_values(["s", "y"], ascending=False), -np.inf, set()
    for s, y in zip(points.s, points.y, strict=True):
        if y > best:
            want.add(("hot", s, y))
            best = y
    assert front == want | {("a", 1.0, 2.0), ("a", 0.5, 3.0)}
    assert R.pareto_front(known, ["g"], "s", "y", most=most).filter("g = 'a'").count() == 3
    area = lambda m: {r["g"]: r["hypervolume"] for r in R.hypervolume(known, ["g"], "s", "y", most=m).collect()}
    small, large = area(10**9), area(most)
    assert small.keys() == large.keys() and all(np.isclose(small[k], large[k], rtol=1e-9) for k in small)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        divided = scans.running_in_ranges(known.filter("s is not null"), ["g"], F.asc("s"), "upto", "y", F.max)
        tasks = [r["count"] for r in divided.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(tasks) < 0.8 * n and sum(tasks) == n + 3
    df.unpersist()


def test_ranks(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0), (2, 7.0)], "o int, s double").withColumn("g", F.lit(1))
    assert [r["rank_norm"] for r in R.rank_normalised(df, ["g"], "s", "o").orderBy("o").collect()] == [0.0, 0.5, 1.0]
    assert R.rank_normalised(df.filter("o = 0"), ["g"], "s", "o").first()["rank_norm"] == 0.5
    many = spark.createDataFrame([(k, None if k % 9 == 0 else float(k % 5)) for k in range(200)], "o int, s double")
    want = sorted(range(200), key=lambda k: (k % 9 == 0, -(k % 5) if k % 9 else 0, k))  # rows without a score keep their order
    assert [r["o"] for r in R.rank_descending(many, "s", "o").orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        R.head(many, "o", 0)
    assert R.first_occurrences(spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, o int"), ["k"], "o").orderBy("o").collect() == [("a", 1), ("b", 2)]


def test_weights(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 6.0), (2, None), (2, None), (3, 0.0)], "g int, w double")
    assert sorted(r["weight_norm"] for r in R.normalised_weights(df, ["g"], "w").collect()) == [0.0, 0.25, 0.5, 0.5, 0.75]


@few
@given(st.text("abcX-", max_size=9), st.text("abcX-", max_size=9))
def test_distance_properties(spark, a, b):
    d, e, t = one(spark, T.distance(F.lit(a), F.lit(b)), T.distance(F.lit(b), F.lit(a)), T.distance_truncated(F.lit(a), F.lit(b)))
    mismatches = sum(x != y for x, y in zip(a, b))
    assert d == e == mismatches + abs(len(a) - len(b)) and t == mismatches


def test_string_functions(spark):
    table = {"AAA": "K", "TAA": "*", "GGG": "G"}
    got = one(spark, T.clean_text(F.lit(" ac-d1e ")), T.clean_id(F.lit("sp|P1|NAME x")), T.clean_id(F.lit("id7 rest")), T.safe_name(F.lit("a b/c" * 40)), T.translate_triplets(F.lit("AAAGGGTAAA"), table), T.translate_to_stop(F.lit("AAATAAGGG"), table), T.translate_triplets(F.lit("AA"), table), T.formatted_key(F.lit("m"), F.lit(7), F.lit(2.135), F.lit(1.0)), T.decode_tokens(F.array(F.lit(0), F.lit(4), F.lit(23), F.lit(24), F.lit(20))), T.prefix_domain(F.lit("abc*"), 3), T.prefix_domain(F.lit("ab"), 3))
    assert got == ("ACDE", "P1", "id7", ("a_b_c" * 40)[:80], "KG", "K", "", "m_0007_rb2.13_wt1.00", "AFYT", "abc", None)
    m = [one(spark, T.parse_metric(F.lit(x)))[0] for x in ("n:3", "plddt:0.9", "tag:x", "plain", ":x", "n:-4")]
    assert [(x["i"], x["d"], x["s"]) if x else None for x in m] == [(3, None, None), (None, 0.9, None), (None, None, "x"), None, None, (-4, None, None)]
    assert one(spark, *[S.min_max(F.lit(x)) for x in (6.0, 8.0, 10.0)], S.min_max(F.lit(6.0), mode="raw")) == (0.0, 0.5, 1.0, 6.0)
    with pytest.raises(ValueError):
        S.min_max(F.lit(1.0), 2.0, 2.0)
    r = one(spark, S.rejection(F.lit(5), F.lit(7)), S.rejection(F.lit(0), F.lit(0)), S.shown(F.lit(float("nan"))), S.shown(F.lit(1.23456), 2))
    assert r[0]["rejected"] == 0 and math.isnan(r[1]["rate"]) and r[2:] == ("—", "1.23")


def test_consensus_and_diversity(spark):
    df = spark.createDataFrame([("g", 0, "AC-T"), ("g", 1, "AG-"), ("g", 2, "TC")], "g string, o int, body string")
    run = lambda **o: A.consensus(df, ["g"], "body", "o", **o).first()["consensus"]
    assert run() == "AC-T" and run(ignore="") == "AC--" and run(ignore="-X*.", none="X") == "ACXT"
    same = spark.createDataFrame([("g", "a")] * 5, "g string, s string")
    assert abs(A.diversity(same, ["g"], "s").first()["conservation"] - 1) < 1e-6
    assert [r["body"] for r in A.to_modal_length(spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "a"), (4, ""), (5, "xyz")], "k int, body string"), "body").orderBy("k").collect()] == ["ABC", "ABC", "A--", "XYZ"]


def test_hierarchy(spark):
    rng = random.Random(1)
    parents = {"n0": None, **{f"n{k}": f"n{rng.randrange(0, k)}" for k in range(1, 60)}}
    e = spark.createDataFrame(list(parents.items()), "node string, parent string")
    inner = set(parents.values())
    leaves = {v for v in parents if v not in inner}

    def below(v):
        return {x for x in leaves if v in chain(x)[1:]}

    def chain(v):
        return [v, *chain(parents[v])] if parents[v] else [v]

    totals = H.subtree_totals(e)
    assert {r["node"]: r["n_leaves"] for r in totals.collect()} == {v: len(below(v)) for v in inner if v}
    chosen = H.closest_to_target(totals, 10)
    held = {r["node"] for r in H.below(e, chosen).collect()}
    assert held == below(chosen.first()["node"])
    parts = H.split(e, H.below(e, chosen)).collect()
    assert {r["node"] for r in parts} == leaves and {r["node"] for r in parts if r["part"] == "holdout"} == held
    kept = set(sorted(leaves)[::3])
    pruned = {r["node"]: r["parent"] for r in H.prune(e, spark.createDataFrame([(v,) for v in kept], "node string")).collect()}
    assert {v for v in pruned if v not in set(pruned.values())} == kept
    counts = pd.Series([p for p in pruned.values() if p]).value_counts()
    assert all(c > 1 for v, c in counts.items() if pruned[v] is not None)
    assert all(p is None or p in chain(v) for v, p in pruned.items())


def _plain_tree(parents):
    """Leaves, and for each inner node how many leaves lie below and the least of them."""
    inner = {p for p in parents.values() if p}
    totals = {}
    for leaf in (v for v in parents if v not in inner):
        v = parents[leaf]
        while v is not None:
            n, first = totals.get(v, (0, leaf))
            totals[v] = (n + 1, min(first, leaf))
            v = parents.get(v)
    return {v for v in parents if v not in inner}, totals


def test_deep_trees(spark):
    """A caterpillar of 20,000 levels with a leaf at every tenth, and a bare chain at its end."""
    parents = {"v00000": None, **{f"v{k:05d}": f"v{k - 1:05d}" for k in range(1, 20_000)}}
    parents |= {f"x{k:05d}": f"v{k:05d}" for k in range(0, 19_900, 10)}
    e = spark.createDataFrame(list(parents.items()), "node string, parent string").repartition(6)
    depth, leaves = 20_000, [f"x{k:05d}" for k in range(0, 19_900, 10)] + ["v19999"]
    want = {}
    for k in range(depth - 1):
        first = -(-k // 10) * 10
        want[f"v{k:05d}"] = (sum(1 for x in range(first, 19_900, 10)) + 1, "v19999")
    got = H.subtree_totals(e).collect()
    assert {r["node"]: (r["n_leaves"], r["first_leaf"]) for r in got} == want
    held = H.below(e, spark.createDataFrame([("v15005",), ("x00030",)], "node string"))
    assert {r["node"] for r in held.collect()} == {x for x in leaves if x >= "x15010" or x in ("x00030", "v19999")}
    kept = ["x00000", "x10000", "x19890", "v19999"]
    pruned = {r["node"]: r["parent"] for r in H.prune(e, spark.createDataFrame([(v,) for v in kept], "node string")).collect()}
    assert pruned == {"v00000": None, "x00000": "v00000", "v10000": "v00000", "x10000": "v10000", "v19890": "v10000", "x19890": "v19890", "v19999": "v19890"}


def test_odd_trees(spark):
    frame = lambda rows: spark.createDataFrame(rows, "node string, parent string")
    repeated = frame([("a", "r"), ("a", "r"), ("b", "r"), ("c", "b")])  # the root stands as a parent only
    assert {tuple(r) for r in H.subtree_totals(repeated).select("node", "n_leaves", "first_leaf").collect()} == {("r", 2, "a"), ("b", 1, "c")}
    assert {r["node"] for r in H.below(repeated, frame([("r", None)])).collect()} == {"a", "c"}
    none = repeated.limit(0)
    assert H.subtree_totals(none).count() == H.below(none, none).count() == H.prune(none, none).count() == 0
    assert H.prune(repeated, none).count() == 0
    with pytest.raises(ValueError):
        H.subtree_totals(frame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")]))


def test_pruning_reaches_all_finished_orders(spark):
    from tarnloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    orders, customers, nations = (pd.read_parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation"))
    up = {f"O{o:09d}": f"C{c:09d}" for o, c in zip(orders.o_orderkey, orders.o_custkey)}
    up |= {f"C{c:09d}": f"N{n:09d}" for c, n in zip(customers.c_custkey, customers.c_nationkey)}
    up |= {f"N{n:09d}": f"R{r:09d}" for n, r in zip(nations.n_nationkey, nations.n_regionkey)}
    leaves = [f"O{o:09d}" for o in orders[orders.o_orderstatus == "F"].o_orderkey]
    children: dict = {}
    for v in leaves:
        while v != "root":
            parent = up.get(v, "root")
            children.setdefault(parent, set()).add(v)
            v = parent
    want = {"root": None}

    def hang(v, parent):
        below = children.get(v, ())
        if len(below) == 1:
            return hang(next(iter(below)), parent)
        want[v] = parent
        for x in below:
            hang(x, v)

    for x in children["root"]:
        hang(x, "root")
    got = {r["node"]: r["parent"] for r in QUERIES["x8_prune_tree"](spark, d).collect()}
    assert got == want and len(leaves) > len(orders) / 4


def test_chains_hold_a_letter_for_every_customer(spark):
    from tarnloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.1"
    t = pd.read_parquet(f"{d}/customer.parquet").sort_values("c_custkey")
    want: dict = {}
    for key, nation in zip(t.c_custkey, t.c_nationkey):
        want[chr(65 + nation)] = want.get(chr(65 + nation), "") + "AGX"[key % 3]
    assert len(t) > 10_000
    assert {r["chain"]: r["body"] for r in QUERIES["s10_chain_letters"](spark, d).collect()} == want


def test_midpoint_root(spark):
    rows = SR.parse_newick("((A:1,B:4)x:2,C:3);")
    e = spark.createDataFrame([("t", *r) for r in rows], "tree_id string, node string, parent string, name string, length double")
    got = H.midpoint_root(e).toPandas().set_index("node")

    def depth(v):
        return 0 if got.parent[v] is None else got.length[v] + depth(got.parent[v])

    depths = {got.loc[v, "name"]: depth(v) for v in got.index if got.loc[v, "name"] in ("A", "B", "C")}
    assert depths["B"] == depths["C"] == 4.5 and depths["A"] == 1.5
    with pytest.raises(ValueError):
        SR.parse_newick("((A,B);")


def test_midpoint_root_of_large_trees(spark):
    draw, rows = random.Random(3), []
    for t in range(12):
        n, back = draw.choice([1, 2, 3, 9, 40]), draw.choice([1, 3, 50])
        for k in range(n):
            parent = None if k == 0 else f"n{draw.randrange(max(0, k - back), k):03d}"
            length = None if k == 0 or draw.random() < 0.05 else float(draw.choice([0, 1, 2, 3, 7])) if t % 2 else draw.random()
            rows.append((f"t{t}", f"n{k:03d}", parent, f"name{k}", length))
    e = spark.createDataFrame(rows, "tree_id string, node string, parent string, name string, length double")
    key = lambda r: [str(round(x, 9)) if isinstance(x, float) else str(x) for x in r]
    assert sorted(map(key, H.midpoint_root(e, in_task=0).collect())) == sorted(map(key, H.midpoint_root(e).collect()))


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = X.sample(df, "k", 10, 1).collect(), X.sample(df, "k", 10, 1).collect()
    assert a == b and len(set(a)) == 10 and a != X.sample(df, "k", 10, 2).collect()
    boot = X.bootstrap(spark.range(1, 11).select(F.col("id").cast("int").alias("pos")), "pos", 10, 3)
    assert boot.count() == 30 and boot.filter("pos < 1 or pos > 10").count() == 0


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_nearest_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    refs = [(k, word(rng.choice([0, 3, 12, 30]))) for k in range(60)] + [(100, "far" * 20), (101, None), (-1, "abc"), (-2, "abc")]
    asked = [(k, word(rng.choice([0, 3, 12, 31]))) for k in range(40)] + [(50, None), (51, "abc"), (52, "abc")]
    for k, (_, text) in enumerate(refs[:40]):
        asked.append((60 + k, "".join(rng.choice("abc") if rng.random() < 0.1 else c for c in text) + "é" * rng.choice([0, 0, 1, 4])))
    gap = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    want = sorted((k, *(min((gap(a, b), i) for i, b in refs if b is not None) if a is not None else (None, None))) for k, a in asked)
    q, r = spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(refs, "i long, body string")
    assert sorted(map(tuple, J.nearest(q, "q", "text", r, "i", "body").collect())) == want


def test_nearest_by_pivots(spark, monkeypatch):
    """Clusters far apart and queries far from all, a long body, ties; far fewer comparisons than the product."""
    monkeypatch.setattr(J, "SMALL", 0)
    monkeypatch.setattr(J, "PIVOT_LENGTH", 70)
    rng = random.Random(6)
    centres = ["".join(rng.choice("abcd") for _ in range(n)) for n in (40, 60, 80, 100, 130) for _ in range(4)]
    changed = lambda c, n: "".join(rng.choice("wxyz") if k in set(rng.sample(range(len(c)), n)) else x for k, x in enumerate(c))
    refs = [(k, changed(rng.choice(centres), 3)) for k in range(400)] + [(900, "q" * 300), (901, "")]
    asked = [(k, changed(rng.choice(centres), 12)) for k in range(120)] + [(500, "zz" * 100), (501, "y" * 9)]
    gap = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    want = sorted((k, *min((gap(a, b), i) for i, b in refs)) for k, a in asked)
    q, r = spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(refs, "i long, body string")
    report: dict = {}
    out = J.nearest(q, "q", "text", r, "i", "body", report)
    assert sorted(map(tuple, out.collect())) == want and max(d for _, d, _ in want) > 50
    assert report["product"] > 40_000 and report["compared"] < 0.35 * report["product"]
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()


def test_range_joins_of_crowded_cells(spark):
    """Half of all points lie in one cell; blocks are much smaller."""
    rng = random.Random(2)
    dense = [(k, rng.random() * 0.9, rng.random() * 0.9) for k in range(400)]
    rest = [(k, rng.random() * 40 - 20, rng.random() * 40 - 20) for k in range(400, 800)] + [(800, None, 1.0), (801, 5.0, float("nan")), (802, 5.0, float("nan")), (804, float("inf"), 0.0), (805, float("inf"), 0.0)]
    points = spark.createDataFrame(dense + rest, "id long, x double, y double")
    left, right = points.filter("id % 3 = 0"), points.filter("id % 3 <> 0")
    plain = [p for p in dense + rest if p[1] is not None and math.isfinite(p[1] + p[2])]
    want = {(a[0], b[0]) for a in plain for b in plain if a[0] % 3 == 0 and b[0] % 3 and math.dist(a[1:], b[1:]) < 1.0}
    for most in (7, 10**6):
        got = [(r["id"], r["other_id"]) for r in J.within(left, right, ["x", "y"], 1.0, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    some = J.any_within(left.union(left), right, ["x", "y"], 1.0)
    assert sorted(r["id"] for r in some.collect()) == sorted(2 * list({a for a, _ in want}))


def test_joins(spark):
    points = spark.createDataFrame([(k, float(k % 7), float(k % 5), float(k % 3)) for k in range(60)], "id long, x double, y double, z double")
    got = {(r["id"], r["other_id"]) for r in J.within(points, points, ["x", "y", "z"], 1.5).collect()}
    p = [(k % 7, k % 5, k % 3) for k in range(60)]
    assert got == {(a, b) for a in range(60) for b in range(60) if math.dist(p[a], p[b]) < 1.5}
    with pytest.raises(ValueError):
        J.nearest(points.select("id", F.lit("a").alias("b")), "id", "b", points.filter("false").select("id", F.lit("a").alias("b")), "id", "b")
    with pytest.raises(ValueError):
        P.at_least_rows(points, 61)


def test_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("n:3 plddt:0.9 tag:x AB/CD/EF\n\n n:1 n:2 A/-\n")
    r = SR.scan_metric_lines(spark, f"file://{tmp_path}/m.txt").collect()
    assert len(r) == 1 and r[0]["target"] == "ACD" and r[0]["item"] == "EF" and r[0]["metrics"]["n"]["i"] == 3
    (tmp_path / "bad.txt").write_text("n:3 nothing\n")
    with pytest.raises(Exception, match="expected target/item"):
        SR.scan_metric_lines(spark, f"file://{tmp_path}/bad.txt").collect()
    (tmp_path / "r.fasta").write_text(">a first\nAC-\nGT\n>b\n\n>a second\nTT\n")
    records = SR.scan_records(spark, f"file://{tmp_path}/r.fasta")
    assert [(x["id"], x["body"]) for x in records.orderBy("ordinal").collect()] == [("a", "AC-GT"), ("b", ""), ("a", "TT")]
    assert {x["id"]: x["body"] for x in SR.record_map(records).collect()} == {"a": "TT", "b": ""}
    assert SR.ungapped_records(records).count() == 2
    (tmp_path / "list.txt").write_text("# c\n\nx.txt\n/abs/y\nx.txt\n")
    assert sorted(x["path"].rsplit("/", 1)[1] for x in SR.scan_paths(spark, f"file://{tmp_path}/list.txt").collect()) == ["x.txt", "y"]
    for k, text in enumerate(('[{"peptide": "AC"}, null]', '{"designs": [{"sequence": "DE"}]}', '{"rows": [{"peptide": "FG", "sequence": "H"}]}', '{"other": 1}')):
        (tmp_path / f"j{k}.json").write_text(text)
    assert sorted(x["item"] for x in SJ.scan_scored_json(spark, f"file://{tmp_path}/j*.json").collect()) == ["AC", "DE", "FG"]
    with pytest.raises(ValueError):
        SJ.first_named(spark.range(1), ("a", "b"), "item")
    with pytest.raises(KeyError, match="valid: a"):
        SR.keyed_lookup({"a": {}}, {}, "b")
    assert SR.keyed_lookup({"a": {"x": 1}}, {"x": 0, "y": 2}, "a") == {"x": 1, "y": 2}


def test_failing_lines_have_their_number(spark, tmp_path):
    lines = [f"n:{k} x:{'y' * (k % 90)} A/C" if k % 7 else "" for k in range(1, 4001)]
    lines[3332] = "n:5 no-slash"
    lines[3887] = "worse"
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("n:1 A/C\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = {(r["source_file"].rsplit("/", 1)[1], r["number"], r["value"]) for r in SR.failing_metric_lines(spark, f"file://{tmp_path}").collect()}
        splits = SR.with_ordinal(spark.read.text(f"file://{tmp_path}/a.txt")).select("ordinal.at").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 5 and found == {("a.txt", 3333, "n:5 no-slash"), ("a.txt", 3888, "worse"), ("b.txt", 2, "last")}
    with pytest.raises(ValueError, match=r"a.txt:3333: expected target/item at the end of: n:5 no-slash"):
        SR.scan_metric_lines(spark, f"file://{tmp_path}")


def test_paged_fetch(spark, tmp_path):
    for page in range(23):
        folder = tmp_path / f"page={page}"
        folder.mkdir()
        rows = [f'{{"id": "A{(20 * page + k) % 90}.{page}", "n": {k}}}' for k in range(20)]
        (folder / "part.json").write_text("{broken" if page == 5 else "\n".join(rows))
    got = paged.scan_pages(spark, paged.folder_of_pages(f"file://{tmp_path}"), 24, pages_a_task=4)  # the last page isn't there
    assert got.rdd.getNumPartitions() == 6 and got.count() == 22 * 20 and not got.filter("page in (5, 23)").count()
    once = {r["id"]: (r["page"], r["place"]) for r in paged.unversioned_once(got, F.get_json_object("body", "$.id")).collect()}
    want = {}
    for page in (k for k in range(23) if k != 5):
        for k in range(20):
            want.setdefault(f"A{(20 * page + k) % 90}", (page, k))
    assert once == want and paged.scan_pages(spark, lambda k: [], 0).count() == 0


def test_incremental_totals_read_new_files_alone(spark, tmp_path):
    folder, state, asked = f"file://{tmp_path}/in", f"file://{tmp_path}/state", []

    def read(paths):
        asked.append(sorted(paths))
        return spark.read.schema("k string, v long, at long").json(paths)

    latest = F.struct("at", "v")
    run = lambda: {r["k"]: (r["n"], r["s"], r["low"], r["last"]["v"]) for r in incremental.update_totals(spark, folder, state, read, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "low": ("min", F.col("v")), "last": ("max", latest)}, "*.json").collect()}
    write = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(f'{{"k": "{k}", "v": {v}, "at": {at}}}' for k, v, at in rows))
    (tmp_path / "in").mkdir()
    write("a.json", [("x", 1, 1), ("y", 5, 1)])
    write("b.json", [("x", 2, 3)])
    assert run() == {"x": (2, 3, 1, 2), "y": (1, 5, 5, 5)}
    write("c.json", [("x", 7, 2), ("z", 1, 1)])
    broken = tmp_path / "state" / "run-00000009-broken" / "totals"  # a run that broke off counts for nothing
    broken.mkdir(parents=True)
    assert run() == {"x": (3, 10, 1, 2), "y": (1, 5, 5, 5), "z": (1, 1, 1, 1)}
    assert run()["x"] == (3, 10, 1, 2)
    assert [[p.rsplit("/", 1)[1] for p in x] for x in asked] == [["a.json", "b.json"], ["c.json"]]
    assert incremental.processed_files(spark, state).count() == 3
    write("a.json", [("x", 1, 1), ("y", 5, 1), ("y", 6, 1)])
    with pytest.raises(ValueError, match="has changed"):
        run()


def test_large_trees_are_read_in_ranges(spark, tmp_path):
    """Bushy trees, a caterpillar, a star, quoted labels, comments and lengths, against the parser of one text."""
    draw = random.Random(3)

    def label():
        return draw.choice(["", f"t{draw.randrange(999)}", "'it, is (one)'", "a b", "x[note, (here)]", "é"]) + draw.choice(["", f":{draw.random():.3f}", ":1e-3"])

    def bushy(n):
        return label() if n <= 1 else "(" + ",".join(bushy(k) for k in ([n // 2, n - n // 2] if draw.random() < 0.7 else [1, n - 2, 1])) + ")" + label()

    deep = "(" * 300 + "a" + "".join(f",b{k}:{k})i{k}:2" for k in range(300))
    texts = {"bushy": bushy(500) + ";", "deep": deep + ";\n", "star": "(" + ",\n".join(f"s{k}:{k}" for k in range(900)) + ")root;  (ignored,", "one": "alone:2;", "open": "(a,b)"}
    for name, text in texts.items():
        (tmp_path / f"{name}.nwk").write_text(text, encoding="utf-8")
    want = sorted((name, *map(str, row)) for name, text in texts.items() for row in SR.parse_newick(text))
    key = lambda r: (r["tree_id"].rsplit("/", 1)[1][:-4], *map(str, (r["node"], r["parent"], r["name"], r["length"])))
    assert sorted(map(key, SR.scan_trees(spark, f"file://{tmp_path}").collect())) == want
    tried = 0
    for size in (997, 1501, 2203):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            assert sorted(map(key, SR.scan_trees(spark, f"file://{tmp_path}", whole=0).collect())) == want
            tried += 1
        except ValueError as e:  # a quoted label lies at the end of a split
            assert "goes on behind the split" in str(e)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tried
    (tmp_path / "bad.nwk").write_text("((a,b);")
    with pytest.raises(ValueError, match="unbalanced"):
        SR.scan_trees(spark, f"file://{tmp_path}/bad.nwk", whole=0)


def test_large_json_arrays_are_read_in_ranges(spark, tmp_path):
    """Nested objects, brackets and quotes in strings, nulls and numbers as elements, objects across splits, several envelopes."""
    import json

    rng = random.Random(12)
    odd = ['a "quoted" }{ ][', "back\\slash\\", "é😀", "", "},{", "plain"]

    def result(k):
        r = {"method": rng.choice(odd), "peptide": f"P{k}", "wt_score": k / 4, "omega": [rng.random() for _ in range(rng.choice([0, 3, 40]))], "per_variant": [[1, 2], {"deep": [{"x": "}"}]}], "nested": {"a": {"b": "]"}}}
        return rng.choice([r, r, r, r, None, 5, "},", [1, {"peptide": "inner"}]])

    rows = lambda n: [result(k) for k in range(n)]
    files = {
        "list": rows(400), "rows": {"meta": {"a": {"peptide": "no"}, "c": [{"peptide": "no"}]}, "rows": rows(300), "after": [{"peptide": "no"}]},
        "two": {"rows": rows(200), "x": 1, "designs": rows(250)}, "empty": {"designs": [], "rows": rows(20)}, "none": {"other": rows(20)}, "nothing": [], "null": {"designs": None, "per_peptide": rows(60)},
    }
    for k, (name, value) in enumerate(files.items()):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=k % 3 or None, ensure_ascii=False) + "\n" * (k % 2), encoding="utf-8")
    (tmp_path / "broken.json").write_text(json.dumps(rows(50))[:-20])
    huge = [{"peptide": "A", "omega": [0.5] * 5000}, {"peptide": "B"}, {"peptide": "C", "per_variant": ["x" * 30_000]}]
    (tmp_path / "huge.json").write_text(json.dumps(huge))
    want = []
    for name, value in {**files, "huge": huge}.items():
        listed = value if isinstance(value, list) else next((value[e] for e in SJ.ENVELOPES if isinstance(value.get(e), list)), [])
        want += [(f"{name}.json", k, r.get("method"), r["peptide"], r.get("wt_score"), tuple(r.get("omega", ()))) for k, r in enumerate(listed) if isinstance(r, dict)]
    key = lambda r: (r["source_file"].rsplit("/", 1)[1], r["source_line"], r["method"], r["peptide"], r["wt_score"], tuple(r["omega"] or ()))
    plain = sorted(map(key, SJ.scan_results(spark, f"file://{tmp_path}/*.json").collect()), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = sorted(map(key, SJ.scan_results(spark, f"file://{tmp_path}/*.json", whole=0).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) > 400 and len(set(want)) == len(want)
    assert [set(plain) - set(want), set(want) - set(plain)] == [set(), set()]
    assert [set(got) - set(want), set(want) - set(got)] == [set(), set()] and len(got) == len(plain) == len(want)


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([("a", 1.5, [1]), ("b", None, [])], "k string, v double, l array<int>")
    assert K.preferred_order(df, ["l", "k"]).columns == ["l", "k", "v"]
    assert K.markdown_table(df.drop("l"), 2).splitlines()[2:] == ["| a | 1.50 |", "| b | — |"]
    K.append_manifest(spark, f"{at}/log", {"a": "1"})
    K.append_manifest(spark, f"{at}/log", {"b": "2"})
    assert sorted(r[0] for r in spark.read.text(f"{at}/log").collect()) == ["a=1", "b=2"]
    ids = spark.createDataFrame([("b", 0), ("x", 1)], "id string, ordinal int")
    assert K.write_listed(spark.createDataFrame([("a", "AC"), ("b", "G" * 130)], "id string, body string"), ids, f"{at}/w") == 1
    assert [(r["id"], r["body"]) for r in SR.scan_records(spark, f"{at}/w").collect()] == [("b", "G" * 130)]


def test_timing_probe_tells_batches_apart(spark):
    import time

    def slow(a, b):
        time.sleep(0.002)
        return a + b

    pairs = spark.range(300).selectExpr("id as a", "id % 7 as b")
    got = {r["batch"]: r for r in W.timing_probe(pairs, "a", "b", slow, (1, 20), 40, 2).collect()}
    assert set(got) == {1, 20} and all(r["rows"] == 40 for r in got.values())
    assert got[1]["seconds"] > 0.08 and got[20]["pairs_a_second"] > 5 * got[1]["pairs_a_second"]


def test_scorer_falls_back_row_by_row(spark):
    def scorer(a, b):
        if len(a) > 1:
            raise RuntimeError("no batches")
        return a + b

    df = spark.createDataFrame([(float(k), 1.0) for k in range(5)], "a double, b double")
    assert sorted(r["score"] for r in W.score_pairs(df, "a", "b", scorer).collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    shuffled = W.shuffled(spark.createDataFrame([("abcabc",)], "b string"), "b").first()["control"]
    assert sorted(shuffled) == sorted("abcabc")


def test_stream_equals_batch(spark, tmp_path):
    stream = rollups.windowed_roll_up(rollups.stream_events(spark, "/root/testdata/sf0.001"), 10.0)
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = rollups.windowed_roll_up(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), 10.0)
    assert sorted(spark.table("rolled").collect()) == sorted(batch.collect())
