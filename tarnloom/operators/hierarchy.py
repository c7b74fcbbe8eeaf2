"""Trees as edge tables (node, parent): subtree sizes, holdouts, pruning and rooting.

Trees of any depth are walked by pointer doubling: each node points to an ancestor, and in each round to the one that its
ancestor points to. What a node has gathered then reaches twice as far, so a tree of 20,000 levels takes 15 rounds, and no
table is larger than the tree. Cycles raise a ValueError. A node that stands as a parent only is a root. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stage

SUM = (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))
MIN = (F.min, F.least)
MAX = (F.max, F.greatest)
IN_TASK = 100_000  # edges of a tree that is rooted in one task
ROOTED = "tree_id string, node string, parent string, name string, length double"


def leaves_of(edges: DataFrame) -> DataFrame:
    return edges.select("node").join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def _nodes(edges: DataFrame) -> DataFrame:
    """(node, up, inner): every node once, with its parent; inner nodes have children."""
    listed = edges.select("node", F.col("parent").alias("up")).distinct()
    inner = edges.filter("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    return listed.join(inner, "node", "full").withColumn("inner", F.coalesce("inner", F.lit(False)))


def _doubled(nodes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Repeat step until no node has an ancestor left to point to (column up).

    step gets the nodes, and them joined to the rows that they point to (columns with a leading underscore, nulls for none).
    """
    state = stage(nodes, "climb")
    rounds = state.count().bit_length() + 1
    while not state.filter("up is not null").isEmpty():
        if not rounds:
            raise ValueError("the edges hold a cycle")
        above = state.select([F.col(c).alias(f"_{c}") for c in state.columns])
        nxt = stage(step(state, state.join(above, F.col("up") == F.col("_node"), "left")).select(state.columns), "climb")
        discard(state)
        state, rounds = nxt, rounds - 1
    return state


def gathered(nodes: DataFrame, how: dict[str, tuple]) -> DataFrame:
    """nodes (node, up and others) with each column of `how` combined over the node and all below it.

    Before a round a node holds what lies less than 2^k levels below it; those that point to it, 2^k levels below, add theirs.
    """

    def step(state: DataFrame, met: DataFrame) -> DataFrame:
        added = state.filter("up is not null").groupBy(F.col("up").alias("_to")).agg(*[each(c).alias(f"_more_{c}") for c, (each, _) in how.items()])
        out = met.withColumn("up", F.col("_up")).join(added, F.col("node") == F.col("_to"), "left")
        return out.withColumns({c: both(F.col(c), F.col(f"_more_{c}")) for c, (_, both) in how.items()})

    return _doubled(nodes, step)


def inherited(nodes: DataFrame, how: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """nodes with each column of `how` combined over the node and its ancestors, nearest first."""
    return _doubled(nodes, lambda _, met: met.withColumns({"up": F.col("_up"), **{c: both(F.col(c), F.col(f"_{c}")) for c, both in how.items()}}))


def subtree_totals(edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(node, n_leaves, first_leaf, total) for each internal node; total sums `value` of values (node, value) over its leaves."""
    leaf = ~F.col("inner")
    nodes = _nodes(edges)
    if values is None:
        nodes = nodes.withColumn("total", F.lit(0.0))
    else:
        nodes = nodes.join(values.select("node", F.col("value").cast("double").alias("total")), "node", "left")
        nodes = nodes.withColumn("total", F.when(leaf, F.coalesce("total", F.lit(0.0))).otherwise(0.0))
    nodes = nodes.withColumns({"n_leaves": leaf.cast("bigint"), "first_leaf": F.when(leaf, F.col("node"))})
    out = gathered(nodes, {"n_leaves": SUM, "first_leaf": MIN, "total": SUM})
    return out.filter("inner").select("node", "n_leaves", "first_leaf", "total")


def below(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node): the leaves under the chosen nodes (or the chosen ones that are leaves), without repeats."""
    marked = _nodes(edges).join(chosen.select("node", F.lit(True).alias("held")).distinct(), "node", "left")
    return inherited(marked, {"held": F.coalesce}).filter(F.col("held") & ~F.col("inner")).select("node")


def closest_to_target(totals: DataFrame, target: int, least: int = 5) -> DataFrame:
    """The node whose number of leaves, within max(least, target / 2) and 1.5 target, is closest to the target.

    Ties go to the subtree with the smallest first leaf, which orders leaf lists of different subtrees. One row, or none.
    """
    fits = totals.filter(F.col("n_leaves").between(max(least, target / 2), 1.5 * target))
    return fits.orderBy(F.abs(F.col("n_leaves") - target), "first_leaf", "node").limit(1)


def closest_or_sample(totals: DataFrame, edges: DataFrame, target: int, least: int = 10, seed: int = 42) -> DataFrame:
    """(node): leaves of the closest subtree; without any that fits, a seeded sample of leaves."""
    from .sampling import sample

    chosen = closest_to_target(totals, target, least)
    return sample(leaves_of(edges), "node", target, seed) if chosen.isEmpty() else below(edges, chosen)


def median_subtree(totals: DataFrame, n_leaves: int, least: int, largest: float, seed: int = 42) -> DataFrame:
    """A node of upper-median size among subtrees of at least `least` leaves and at most that fraction of all; else among all with 2 leaves or more but not all.

    Ties are broken by a seeded hash. One row, or none.
    """
    from .sampling import seeded

    fits = totals.filter((F.col("n_leaves") >= least) & (F.col("n_leaves") <= largest * n_leaves))
    fits = totals.filter((F.col("n_leaves") > 1) & (F.col("n_leaves") < n_leaves)) if fits.isEmpty() else fits
    sizes = fits.select("n_leaves").distinct()
    middle = sizes.agg(F.array_sort(F.collect_set("n_leaves")).alias("s")).select(F.get("s", (F.size("s") / 2).cast("int")).alias("n_leaves"))
    return fits.join(F.broadcast(middle), "n_leaves").orderBy(seeded(seed, "node"), "node").limit(1)


def closest_mean(totals: DataFrame, constant: float, least: int = 1) -> DataFrame:
    """The node whose mean value per leaf is closest to a constant. One row, or none."""
    mean = F.col("total") / F.col("n_leaves")
    return totals.filter(F.col("n_leaves") >= least).withColumn("mean_value", mean).orderBy(F.abs(mean - constant), "first_leaf", "node").limit(1)


def split(edges: DataFrame, holdout: DataFrame) -> DataFrame:
    """(node, part): every leaf as `holdout` or `train`."""
    return leaves_of(edges).join(holdout.select("node", F.lit("holdout").alias("part")), "node", "left").select("node", F.coalesce("part", F.lit("train")).alias("part"))


def prune(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges to the kept leaves and their ancestors, with inner nodes of a single child taken out. The root stays."""
    marked = _nodes(edges).join(kept.select("node", F.lit(1).alias("kept")).distinct(), "node", "left")
    alive = gathered(marked.withColumn("kept", F.coalesce("kept", F.lit(0))), {"kept": SUM}).filter("kept > 0")
    tree = stage(edges.select("node", F.col("parent").alias("up")).distinct().join(alive, "node", "left_semi"), "alive")

    single = tree.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select("node")
    single = single.join(tree.filter("up is not null"), "node", "left_semi").withColumn("gone", F.lit(True))  # not the root
    state = tree.join(single, "node", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    state = state.join(single.select(F.col("node").alias("up"), F.col("gone").alias("chained")), "up", "left")
    state = stage(state.select("node", "up", "gone", F.coalesce("chained", F.lit(False)).alias("chained")), "chains")
    while not state.filter("chained").isEmpty():  # those whose parent goes point to what that points to
        via = state.filter("gone").select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("chained").alias("_chained"))
        moved = state.filter("chained").join(via, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"), "gone", F.col("_chained").alias("chained"))
        nxt = stage(state.filter("not chained").unionByName(moved), "chains")
        discard(state)
        state = nxt
    return state.filter("not gone").select("node", F.col("up").alias("parent"))


def _far(tree: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """tree (node, up, deep, hops) with the path length, edges and lowest common ancestor's depth to each tree's start.

    starts: (tree_id, node). Columns: on_{name} marks the start and its ancestors, {name}_d and {name}_h are the distances.
    """
    mark, d, h = f"on_{name}", f"{name}_d", f"{name}_h"
    at = starts.select(F.struct("tree_id", "node").alias("node"), F.lit(1).alias(mark))
    marked = gathered(tree.join(at, "node", "left").withColumn(mark, F.coalesce(mark, F.lit(0))).withColumn("parent", F.col("up")), {mark: MAX})
    both = F.when(F.col(mark) == 1, F.struct("deep", "hops"))
    met = inherited(marked.withColumn("up", F.col("parent")).withColumn("_meets", both).withColumnRenamed("_meets", "meets"), {"meets": F.coalesce})
    own = starts.join(tree.select(F.col("node.tree_id").alias("tree_id"), F.col("node.node").alias("node"), "deep", "hops"), ["tree_id", "node"])
    own = own.select("tree_id", F.col("deep").alias("_deep"), F.col("hops").alias("_hops"))
    out = met.withColumn("tree_id", F.col("node.tree_id")).join(own, "tree_id").withColumn("up", F.col("parent"))
    out = out.withColumns({d: F.col("deep") + F.col("_deep") - 2 * F.col("meets.deep"), h: F.col("hops") + F.col("_hops") - 2 * F.col("meets.hops")})
    return stage(out.drop("tree_id", "parent", "meets", "_deep", "_hops"), "far")


def _root_of_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of one tree, rooted anew."""
    near: dict[str, dict[str, float]] = {}
    for r in pdf.itertuples():
        near.setdefault(r.node, {})
        if isinstance(r.parent, str):
            length = 0.0 if pd.isna(r.length) else float(r.length)
            near[r.node][r.parent] = length
            near.setdefault(r.parent, {})[r.node] = length
    names, tree = dict(zip(pdf.node, pdf.name, strict=True)), pdf.tree_id.iloc[0]

    def far(start: str) -> tuple[dict[str, float], dict[str, str | None]]:
        dist, back, todo = {start: 0.0}, {start: None}, [start]
        while todo:
            v = todo.pop()
            for w, d in near[v].items():
                if w not in dist:
                    dist[w], back[w] = dist[v] + d, v
                    todo.append(w)
        return dist, back

    tips = sorted(v for v, e in near.items() if len(e) <= 1)
    if len(near) < 2 or not tips:
        return pdf[["tree_id", "node", "parent", "name", "length"]]
    d, _ = far(tips[0])
    a = max(tips, key=lambda v: (d[v], v))
    d, back = far(a)
    b = max(tips, key=lambda v: (d[v], v))
    half, slack, v = d[b] / 2, d[b] * 1e-12, b
    while back[v] is not None and d[back[v]] > half + slack:
        v = back[v]
    top = back[v]
    if top is None or d[top] >= half - slack:
        new = top or v
    else:
        new = "midpoint"
        near[new] = {v: d[v] - half, top: half - d[top]}
        near[v][new], near[top][new] = near[new][v], near[new][top]
        del near[v][top], near[top][v]
    dist, back = far(new)
    rows = [(tree, x, back[x], names.get(x), near[x][back[x]] if back[x] is not None else None) for x in sorted(dist)]
    return pd.DataFrame(rows, columns=["tree_id", "node", "parent", "name", "length"])


def midpoint_root(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Edges (tree_id, node, parent, name, length) of each tree rooted at the middle of its longest path between tips.

    A tip has one neighbour, so a root of one child is one. The path's ends are the tip farthest from the least tip, then the
    tip farthest from that; ties go to the largest name. If no node stands in the middle, to 1e-12 of the path, the edge there
    is cut by a node `midpoint`. Missing lengths count as 0, and trees of one node stay as they are. Trees of at most in_task rows
    are rooted one a group; larger ones are rows of a table like any other, spread over the tasks.
    """
    large = edges.groupBy("tree_id").count().filter(F.col("count") > in_task).select("tree_id")
    out = edges.join(large, "tree_id", "left_anti").groupBy("tree_id").applyInPandas(_root_of_one, ROOTED)
    return out if large.isEmpty() else out.union(_root_of_large(edges.join(large, "tree_id", "left_semi")))


def _root_of_large(edges: DataFrame) -> DataFrame:
    """midpoint_root by joins of tables: distances from ancestors' depths, the path by marks that climb from its ends."""
    rows = edges.select("tree_id", F.struct("tree_id", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tree_id", F.col("parent").alias("node"))).alias("up"), "name", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    parents = rows.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("children"))
    rows = rows.drop("tree_id").join(parents, "node", "full").withColumn("length", F.coalesce("length", F.lit(0.0)))
    tip = F.col("children").isNull() | (F.col("up").isNull() & (F.col("children") == 1))
    rows = rows.withColumns({"tip": tip, "deep": F.when(F.col("up").isNull(), 0.0).otherwise(F.col("length")), "hops": F.col("up").isNotNull().cast("bigint"), "parent": F.col("up")})
    nodes = inherited(rows, {"deep": lambda a, b: a + F.coalesce(b, F.lit(0.0)), "hops": SUM[1]}).withColumn("up", F.col("parent")).drop("parent")
    nodes = stage(nodes, "deep")
    tree_id, name = F.col("node.tree_id").alias("tree_id"), F.col("node.node")
    large = nodes.groupBy(tree_id).agg(F.count("*").alias("n"), F.min(F.when(F.col("tip"), name)).alias("node")).filter("n > 1")

    bare = nodes.select("node", "up", "deep", "hops", "tip")
    farthest = lambda df, d: df.filter("tip").groupBy(F.col("node.tree_id").alias("tree_id")).agg(F.max(F.struct(d, F.col("node.node").alias("node"))).alias("top")).select("tree_id", F.col("top.node").alias("node"))
    ends_a = stage(farthest(_far(bare, large.select("tree_id", "node"), "t"), "t_d"), "ends")
    from_a = _far(bare, ends_a, "a")
    ends_b = stage(farthest(from_a, "a_d"), "ends")
    from_b = _far(from_a, ends_b, "b")

    whole = from_b.groupBy(tree_id).agg(F.max(F.when(F.col("tip"), F.col("a_d"))).alias("whole"))
    on_path = ((F.col("on_a") + F.col("on_b")) == 1) | (F.col("a_h") + F.col("b_h") == F.col("apart"))
    apart = ends_b.select(F.struct("tree_id", "node").alias("node")).join(from_b, "node").select(tree_id, F.col("a_h").alias("apart"))
    path = from_b.filter("on_a + on_b > 0").withColumn("tree_id", F.col("node.tree_id")).join(whole, "tree_id").join(apart, "tree_id").filter(on_path)
    half, slack = F.col("whole") / 2, F.col("whole") * 1e-12
    beyond = F.min(F.when(F.col("a_d") > half + slack, F.col("a_h")))
    cut = path.groupBy("tree_id").agg(F.coalesce(beyond, F.max("apart")).alias("v_at"))  # the first node behind the middle, or the end
    side = path.join(cut, "tree_id").filter(F.col("a_h").isin(F.col("v_at"), F.col("v_at") - 1))
    at = lambda back, what: F.max(F.when(F.col("a_h") == F.col("v_at") - back, what))
    side = side.groupBy("tree_id").agg(at(0, F.col("node")).alias("v"), at(1, F.col("node")).alias("top"), at(0, F.col("a_d") - half).alias("v_length"), at(1, half - F.col("a_d")).alias("top_length"), at(0, F.col("on_a")).alias("v_on_a"), F.max(slack).alias("slack"))
    # Where the start is the only end, or the node before lies in the middle, that is the new root; else the edge is cut.
    root = F.when(F.col("top").isNull(), F.col("v")).when(F.col("top_length") <= F.col("slack"), F.col("top"))
    side = stage(side.withColumn("root", root), "middle")

    # v hangs below top, or top below v; what lies above the new root turns over.
    placed = nodes.withColumn("tree_id", F.col("node.tree_id")).join(side, "tree_id")
    lower = F.col("up").eqNullSafe(F.when(F.col("node") == F.col("v"), F.col("top")).when(F.col("node") == F.col("top"), F.col("v"))) & F.col("root").isNull()
    turned = F.when(F.col("root").isNotNull(), F.col("node") == F.col("root")).otherwise(F.col("node").isin(F.col("v"), F.col("top")) & ~lower)
    placed = placed.withColumns({"lower": F.coalesce(lower, F.lit(False)), "turns": F.coalesce(turned, F.lit(False)).cast("int"), "parent": F.col("up")})
    keep = ["node", "up", "parent", "name", "length", "lower", "turns", "first"]
    placed = gathered(placed.withColumn("first", F.col("turns") == 1).select(keep), {"turns": MAX}).withColumn("up", F.col("parent"))
    turning = placed.filter("turns = 1 and up is not null").select(F.col("up").alias("_node"), F.col("node").alias("_child"), F.col("length").alias("_length"))
    placed = placed.join(turning, F.col("node") == F.col("_node"), "left").withColumn("tree_id", F.col("node.tree_id")).join(side.drop("slack"), "tree_id")

    middle = F.lit("midpoint")
    own = F.when(F.col("node") == F.col("v"), F.col("v_length")).otherwise(F.col("top_length"))
    cut_here = F.col("root").isNull() & F.col("node").isin(F.col("v"), F.col("top")) & (F.col("lower") | F.col("first"))
    parent = F.when(cut_here, middle).when(F.col("first"), F.lit(None).cast("string")).when(F.col("turns") == 1, F.col("_child.node")).otherwise(F.col("up.node"))
    length = F.when(cut_here, own).when(F.col("first"), F.lit(None).cast("double")).when(F.col("turns") == 1, F.col("_length")).otherwise(F.col("length"))
    out = placed.select("tree_id", name.alias("node"), parent.alias("parent"), "name", length.alias("length"))
    fresh = side.filter("root is null").select("tree_id", middle.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("length"))
    small = edges.join(large.select("tree_id"), "tree_id", "left_anti").select("tree_id", "node", "parent", "name", "length")
    return out.unionByName(fresh).unionByName(small)


def status_report(targets: DataFrame, name: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """(name, status, reason): skipped with the reason of the first check that holds, else ok."""
    reason = F.lit(None).cast("string")
    for condition, text in reversed(checks):
        reason = F.when(condition, F.lit(text)).otherwise(reason)
    out = targets.select(name, reason.alias("reason"))
    return out.select(name, F.when(F.col("reason").isNull(), "ok").otherwise("skipped").alias("status"), "reason")


