"""Joins of items, scenarios and records. A side is only broadcast by Spark's own size check, or where it is one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distance, formatted_key
from ..storage import discard, stage

SMALL = 8 << 20  # bytes of distinct bodies that are sent to every task
PIVOTS, PIVOT_LENGTH = 32, 4096  # bodies that distances are measured to, and their characters
BLOCK = 1 << 14  # rows of a grid cell's side that meet others in one task
REACHES = (0, 1, 3, 7)  # distances up to which neighbours are found by parts of bodies that agree


def members(records: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    return records.join(leaves, key, "left_semi")


def others(records: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return records.join(holdout, key, "left_anti")


def matched(aligned: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    return aligned.join(raw, key)


def augmented(results: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """All results, with the scores of their item or nulls; scores without a key never match."""
    return results.join(scores.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), key, "left")


def augmented_by_key(results: DataFrame, scores: DataFrame, method: str, index: str, robust: str, baseline: str) -> DataFrame:
    """All results with the scores stored under the formatted key of their stable index."""
    return results.withColumn("key", formatted_key(method, F.col(index).cast("int"), robust, baseline)).join(scores, "key", "left")


def pairs(items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every item with every scenario: the definition of a score matrix."""
    return items.crossJoin(scenarios)


def _least(candidates: DataFrame) -> DataFrame:
    """(_q, s): the least (distance, id) of each query body; pairs are reduced within a task before the shuffle."""
    return candidates.select("_q", F.struct(distance("_q", "_o").alias("d"), F.col("_id").alias("id")).alias("s")).groupBy("_q").agg(F.min("s").alias("s"))


def _in_pieces(rows: DataFrame, body: str, n: int) -> DataFrame:
    """rows, n times each: a hash of the characters at every n-th place, and where these places begin."""
    piece = lambda k: F.xxhash64(F.array_join(F.filter(F.split(F.col(body), ""), lambda _, at: at % n == k), ""))
    return rows.select("*", F.posexplode(F.array(*[piece(k) for k in range(n)])).alias("_from", "_piece"))


def _indexed(left: DataFrame, ref: DataFrame, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_q, s): the least (distance, id) of each query body, by distances to PIVOTS bodies and the triangle inequality.

    A body of the others lies in the ring of its nearest pivot that its distance names. First a query looks into the ring that
    promises most; what it finds there bounds the rest: a ring is read only if its distance from the pivot allows as near a
    body, and a body is compared only if its distances to all pivots do. Where many bodies share a ring, adaptive execution
    divides the join. Pivots are points of the same space cut to PIVOT_LENGTH characters, so their size is bounded.
    """
    pivots = [r[0] for r in ref.orderBy(F.xxhash64("_o"), "_o").limit(PIVOTS).select(F.substring("_o", 1, PIVOT_LENGTH)).collect()]
    to_pivots = lambda c: F.array(*[distance(c, F.lit(p)) for p in pivots])
    ref = ref.withColumn("_d", to_pivots("_o")).withColumn("_ring", F.array_min("_d"))
    ref = stage(ref.withColumn("_pivot", (F.array_position("_d", F.col("_ring")) - 1).cast("int")), "rings")
    rings = ref.groupBy("_pivot", "_ring").agg(F.count("*").alias("_n"))  # at most PIVOTS times as many as bodies have lengths
    left = stage(left.withColumn("_e", to_pivots("_q")), "queries")

    met = left.select("_q", "_e", F.posexplode("_e").alias("_pivot", "_far")).join(rings, "_pivot")
    apart = F.abs(F.col("_far") - F.col("_ring"))
    # Some body of a ring is at most this far; the ring with the least such bound is read first.
    first = met.groupBy("_q").agg(F.min(F.struct((F.col("_far") + F.col("_ring")).alias("most"), "_pivot", "_ring")).alias("f"))
    first = first.join(left, "_q").select("_q", "_e", F.col("f.*"))
    found = count(first.join(ref, ["_pivot", "_ring"]).filter(_allowed(F.col("most"))))
    bound = stage(_least(found), "bounds")

    rest = met.join(bound, "_q").filter(apart <= F.col("s.d")).select("_q", "_e", "_pivot", "_ring", F.col("s.d").alias("_best"))
    found = count(rest.join(ref, ["_pivot", "_ring"]).filter(_allowed(F.col("_best"))))
    return _least(found)


def _allowed(most: Column) -> Column:
    """Whether the distances of a query (_e) and a body (_d) to all pivots leave a distance of at most `most` open."""
    return F.array_max(F.zip_with("_e", "_d", lambda x, y: F.abs(x - y))) <= most


def nearest(queries: DataFrame, query: str, body: str, others: DataFrame, other: str, other_body: str, report: dict | None = None) -> DataFrame:
    """Least distance of each query to any row of the others, and the first (least) row at it; ValueError if there is none.

    Equal bodies are compared once. A null body is compared with nothing: a query's distance and nearest are null then.
    Others of at most SMALL bytes go to every task. Beyond that queries with a neighbour at a distance of 7 or less are
    found by equi-joins: of n places' sets, two bodies that differ in less than n places (the longer one's rest included)
    agree in one. The queries left are compared by an index of distances to pivots. With a dict `report`, pairs that were
    compared by the index and those that all others would have made are counted in it, which takes a job more.
    """
    ref = others.filter(F.col(other_body).isNotNull()).groupBy(F.col(other_body).alias("_o")).agg(F.min(other).alias("_id"))
    left = queries.filter(F.col(body).isNotNull()).select(F.col(body).alias("_q")).distinct()
    held = ref.agg(F.sum(F.octet_length("_o") + 16)).first()[0]
    if held is None:
        raise ValueError("nothing to compare with")
    if held <= SMALL:
        best = _least(left.crossJoin(F.broadcast(ref)))
    else:
        ref, left, found = stage(ref, "bodies"), stage(left, "queries"), []
        for reach in REACHES:
            met = _in_pieces(left, "_q", reach + 1).join(_in_pieces(ref, "_o", reach + 1), ["_from", "_piece"])
            found.append(stage(_least(met).filter(F.col("s.d") <= reach), "nearest"))
            rest = stage(left.join(found[-1], "_q", "left_anti"), "queries")
            discard(left)
            left = rest

        def count(pairs: DataFrame) -> DataFrame:
            if report is not None:
                report["compared"] = report.get("compared", 0) + pairs.count()
            return pairs

        if report is not None:
            report["product"] = left.count() * ref.count()
        if not left.isEmpty():
            found.append(_indexed(left, ref, count))
        best = reduce(DataFrame.union, found)
    return queries.join(best, queries[body] == F.col("_q"), "left").select(query, F.col("s.d").alias("distance"), F.col("s.id").alias("nearest"))


def _gap(axes: list[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(a) - F.col(f"other_{a}"), F.lit(2.0)) for a in axes), F.lit(0.0)))


def _cell(x: Column, side: float) -> Column:
    """The grid cell of a coordinate; null where it isn't finite or too large to tell cells apart."""
    return F.when(F.abs(x / side) < 2.0**52, F.floor(x / side))


def _celled(points: DataFrame, others: DataFrame, axes: list[str], radius: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points with the grid cell that they lie in, others (columns other_*) in their own and all neighbouring cells."""
    cells = [f"_c{k}" for k in range(len(axes))]
    left = points.withColumns({c: _cell(F.col(a), radius) for c, a in zip(cells, axes, strict=True)})
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{k}") for k, v in enumerate(o)]) for o in product((-1, 0, 1), repeat=len(axes))])
    right = others.select(*[F.col(c).alias(f"other_{c}") for c in others.columns]).withColumn("_o", F.explode(offsets))
    right = right.withColumns({f"_c{k}": _cell(F.col(f"other_{a}"), radius) + F.col(f"_o.o{k}") for k, a in enumerate(axes)}).drop("_o")
    return left, right, cells


def within(points: DataFrame, others: DataFrame, axes: list[str], radius: float, most: int = BLOCK) -> DataFrame:
    """Pairs of points nearer than the radius (all columns of both): an equi-join on grid cells, then the exact test.

    The other side is copied to the neighbouring cells only. A cell of more than `most` rows of a side is cut into blocks of
    about that many rows; a block meets every block of the other side in a task of its own, so no task holds a whole cell.
    """
    left, right, cells = _celled(points, others, axes, radius)
    on = list(cells)
    if all(df.count() <= most for df in {id(x): x for x in (points, others)}.values()):  # then no cell has more of a side
        return left.join(right, cells).filter(_gap(axes) < radius).drop(*cells)
    sizes = left.select(*cells, F.lit(0).alias("_side")).unionByName(right.select(*cells, F.lit(1).alias("_side")))
    sizes = sizes.groupBy(*cells).agg(*[F.ceil(F.count_if(F.col("_side") == k) / most).cast("int").alias(n) for k, n in enumerate(("_ln", "_rn"))])
    heavy = stage(sizes.filter("_ln > 0 and _rn > 0 and _ln + _rn > 2"), "heavy")
    if not heavy.isEmpty():
        own = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(n, F.lit(1))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
        left = left.join(heavy, cells, "left").withColumn("_lb", own(F.col("_ln"))).withColumn("_rb", every("_rn"))
        right = right.join(heavy, cells, "left").withColumn("_rb", own(F.col("_rn"))).withColumn("_lb", every("_ln"))
        left, right, on = left.drop("_ln", "_rn"), right.drop("_ln", "_rn"), [*cells, "_lb", "_rb"]
    return left.join(right, on).filter(_gap(axes) < radius).drop(*on)


def any_within(points: DataFrame, others: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """Points with at least one of the others nearer than the radius. No pairs are made.

    Cells whose diagonal is below the radius come first: a point that shares one with any of the others is in. So dense
    places cost one row a cell. Only what is left looks into neighbouring cells, each point up to its first match.
    """
    side = radius / len(axes) ** 0.5 * (1 - 1e-9)
    fine = [_cell(F.col(a), side).alias(f"_f{k}") for k, a in enumerate(axes)]
    taken = stage(others.select(*fine).distinct(), "cells")
    names = [f"_f{k}" for k in range(len(axes))]
    marked = points.withColumns(dict(zip(names, fine, strict=True)))
    sure = marked.join(taken, names, "left_semi").select(points.columns)
    left, right, cells = _celled(marked.join(taken, names, "left_anti").select(points.columns), others.select(*axes), axes, radius)
    near = _gap(axes) < radius
    for c in cells:
        near = near & (F.col(c) == F.col(f"_to{c}"))
    rest = left.join(right.withColumnsRenamed({c: f"_to{c}" for c in cells}), near, "left_semi")
    return sure.union(rest.select(points.columns))


def with_label(df: DataFrame, labels: DataFrame, tag: str) -> DataFrame:
    return df.join(labels, tag, "left")


def beginnings(texts: DataFrame, text: str, names: DataFrame, name: str, out: str) -> DataFrame:
    """texts with `out`: each beginning of the text that is as long as some name; a row for each.

    The distinct lengths of names go to the driver; there are no more of them than the longest name has characters.
    """
    sizes = sorted(r[0] for r in names.select(F.length(name)).distinct().collect() if r[0])
    some = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length(text))
    return texts.withColumn(out, F.explode(F.transform(some, lambda n: F.substring(F.col(text), F.lit(1), n))))


def runs_with_files(runs: DataFrame, files: DataFrame, name: Column, tag: str, path: str) -> DataFrame:
    """Runs with the file of their tag; without one, the last path whose tag begins with the run's name."""
    exact = files.groupBy(tag).agg(F.max(path).alias("_exact"))
    named = runs.withColumn("_name", name)
    begun = beginnings(files, tag, named, "_name", "_b").groupBy("_b").agg(F.max(path).alias("_begun"))
    found = named.join(exact, F.col("_name") == exact[tag], "left").join(begun, F.col("_name") == F.col("_b"), "left")
    return found.select(*runs.columns, F.coalesce("_exact", "_begun").alias(path))
