"""Mixing sources to target weights: hierarchical budgets, then a seeded token-prefix of each leaf. DataFrame functions only.

Capacities add up from the leaves; budgets go down. At each node the budget is poured over the children by weight, and what a
full child can't take goes to its siblings. A whole subtree's shortage shows in its capacity, so only what all siblings
together lack reaches the branch above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .packing import words

DIGITS = 2  # hexadecimal digits by which a leaf's order is cut into 256 slices, and a slice into 256 more
SLICE_ROWS = 4096  # a slice of more rows is cut again before its rows are ranked


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A seeded order of documents, another one in each epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def weight_of(weights: dict[str, int], value: Column, default: int) -> Column:
    """Integer weight by name; names that aren't listed get the default."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(value == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def pour(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add `alloc` (whole tokens) to children (parent columns, child, capacity, weight above 0, budget of the parent).

    The least capacity for its weight fills first; who isn't full shares the rest by weight. What rounding down leaves goes,
    a token each, to the first ones by name that aren't full. So the children get all of the budget, or are all full.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.sum("capacity").over(order) - F.col("capacity")
    still = F.sum("weight").over(by) - F.sum("weight").over(order) + F.col("weight")
    rows = children.withColumn("_before", before).withColumn("_open", still)
    room = (F.col("budget") - F.col("_before")).cast("decimal(38,0)")
    rows = rows.withColumn("_full", F.col("capacity") * F.col("_open") <= room * F.col("weight"))
    rows = rows.withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by))
    rows = rows.withColumn("_rest", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by))
    share = F.floor(F.greatest(F.col("_left"), F.lit(0)).cast("decimal(38,0)") * F.col("weight") / F.col("_rest")).cast("long")
    rows = rows.withColumn("_share", F.when(F.col("_full"), F.lit(0)).otherwise(share))
    rows = rows.withColumn("_odd", F.greatest(F.col("_left"), F.lit(0)) - F.sum("_share").over(by))
    place = F.row_number().over(by.orderBy("_full", child))
    alloc = F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("_share") + (place <= F.col("_odd")).cast("long"))
    return rows.withColumn("alloc", alloc.cast("long")).drop("_before", "_open", "_full", "_left", "_rest", "_share", "_odd")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], default: int, total: Column, epochs: int) -> DataFrame:
    """leaves (levels, tokens) with `alloc`: each leaf's budget of at most epochs times its tokens.

    A leaf below a node of weight 0 gets nothing and counts for no capacity, so a shortage there shows at once to its
    siblings. The total is taken over all leaves.
    """
    path_weights = [weight_of(w, F.col(level), default) for w, level in zip(weights, levels, strict=True)]
    live = leaves.filter(F.least(*path_weights, F.lit(1)) > 0)
    nodes = live.withColumn("capacity", F.col("tokens") * epochs)
    above = leaves.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all")).select(total.cast("long").alias("budget"))
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        here = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", path_weights[depth])
        here = here.join(above, levels[:depth]) if depth else here.crossJoin(F.broadcast(above))  # one row
        above = pour(here, levels[:depth] or [F.lit(0)], level).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "alloc"), levels, "left").withColumn("alloc", F.coalesce("alloc", F.lit(0)))


def _last_slices(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows (names, _k, n_tokens, rest) into those before each leaf's last slice, and that slice with its rest.

    A slice of more than SLICE_ROWS rows is cut again by the next digits; the key ends in the text's hash, so once all
    digits are used up a slice's rows are equal. A window sees at most 256 sums of a leaf.
    """
    taken = None
    for at in range(0, 64, DIGITS):
        digit = F.substring("_k", at + 1, DIGITS)
        sums = rows.groupBy(*names, digit.alias("_d")).agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"), F.count("*").alias("rows"))
        before = F.sum("t").over(Window.partitionBy(*names).orderBy("_d")) - F.col("t")
        ends = sums.withColumn("_before", before).filter("_before < rest and _before + t >= rest")
        ends = stage(ends.select(*names, F.col("_d").alias("_end"), "_before", "rows"), "ends")
        cut = rows.join(ends.drop("rows"), names)
        here = cut.filter(digit < F.col("_end")).select(rows.columns)
        taken = here if taken is None else taken.union(here)
        rows = cut.filter(digit == F.col("_end")).withColumn("rest", F.col("rest") - F.col("_before")).select(rows.columns)
        most = ends.agg(F.max("rows")).first()[0] or 0
        if most <= SLICE_ROWS:
            break
        rows = stage(rows, "slice")
    return taken, rows


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], share: tuple[int, int] = (4, 5), epochs: int = 2, seed: int = 11, default: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and epoch in which it is taken: doc_id, the levels, epoch (from 0), n_tokens, taken.

    levels names the tree's columns from the root down; a null there is the branch `unknown`. The budget is share[0] /
    share[1] of all tokens. A leaf's stream is its documents in the seeded order of epoch 0, then of epoch 1 and so on; it gives
    the prefix of as many tokens as its budget, so the last document may give fewer tokens than it has. Documents without
    tokens (null, empty or blank text) are never taken, and an empty table gives no rows. Rows without an id are ordered by
    their text's hash, repeated rows are taken one by one, and other columns of docs are ignored.

    No leaf is sorted as a whole: sums over slices of the order find the slice in which the prefix ends, again and again until
    it is small, and only that slice is ranked. Equal rows are counted before, so they cost the rank one row.
    """
    names = list(levels)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()], words(text_col).alias("n_tokens"), F.md5(text).alias("_h"))
    rows = stage(rows.filter("n_tokens > 0"), "tokens")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    total = F.floor(F.col("_all") * share[0] / share[1])
    plan = budgets(leaves, names, weights, default, total, epochs).withColumn("full", F.floor(F.col("alloc") / F.col("tokens")).cast("int"))
    plan = stage(plan.select(*names, "full", (F.col("alloc") - F.col("full") * F.col("tokens")).alias("rest")), "plan")
    own = F.coalesce(F.col("doc_id").cast("string"), F.col("_h"))
    partial = rows.join(plan.filter("rest > 0"), names).withColumn("_k", F.concat(order_key(seed, F.col("full"), own), "_h"))
    partial = partial.select("doc_id", *names, F.col("full").alias("epoch"), "n_tokens", "_k", "rest")
    inside, last = _last_slices(partial, names)
    out = ["doc_id", *names, "epoch", "n_tokens"]
    equal = last.groupBy(*out, "_k").agg(F.count("*").alias("_m"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*names).orderBy("_k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("n_tokens") * F.col("_m")
    equal = equal.withColumn("_left", F.col("rest") - (F.sum(size).over(upto) - size)).filter("_left > 0")
    whole_ones = F.least(F.col("_m"), F.floor(F.col("_left") / F.col("n_tokens")).cast("long"))
    equal = equal.withColumn("_w", whole_ones).withColumn("_odd", F.when(F.col("_w") < F.col("_m"), F.col("_left") - F.col("_w") * F.col("n_tokens")).otherwise(0))
    every = equal.filter("_w > 0").select(*out, F.explode(F.sequence(F.lit(1), F.col("_w"))).alias("_c"), F.col("n_tokens").alias("taken")).drop("_c")
    odd = equal.filter("_odd > 0").select(*out, F.col("_odd").alias("taken"))
    again = rows.join(plan.filter("full > 0"), names).select("doc_id", *names, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    return again.union(inside.select(*out, F.col("n_tokens").alias("taken"))).union(every).union(odd)
