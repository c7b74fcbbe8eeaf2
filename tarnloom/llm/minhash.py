"""Near-duplicate documents by a chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018).

1. Every row's shingle set is hashed; rows with equal sets form one class and are never expanded into pairs.
2. Each class walks random trees. A node picks a minwise coordinate (with probability 1/threshold - 1 a second),
   and the class moves to the child named by its value there. Independent trees repeat until the target recall is met
   for a pair exactly at the threshold.
3. Small nodes are compared exhaustively on packed minwise bits. The members of a crowded node are compared with its pivot
   alone, row by row, so they need not meet in one task: what equals the pivot leaves the node, what could be linked to
   something that left stays joined to the pivot. The rest goes a level deeper; at the last level all members are joined to
   the pivot. This makes candidate groups, never fewer links.
4. In each candidate group the pairs whose packed bits are near enough are confirmed on full sets; large groups are compared
   in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, quoted, run_bounds, shuffle_parts, spread_labels, stage, text_bytes, whole_runs
from .graph import connected_components

COORDS = 128  # minwise coordinates of a class
BITS = 2  # packed bits of each coordinate
NODE_LIMIT = 192  # members of a node that are compared exhaustively
BLOCK = 384  # documents of a candidate group whose full sets are held at once
FILTER_BITS = 1 << 26  # most bits of the bitmap that spares the second scan's shuffle (8 MB)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    tokens = text.lower().split()  # on bytes: A-Z only, and exactly space, \t, \n, \v, \f, \r
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 + len(h) * (len(h) < words), np.uint64)
    for k in range(n):
        out = mix64(out ^ h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def minwise(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """COORDS minima of 32-bit linear permutations of a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * a + b).min(0), out=best)
    return best


def tree_count(recall: float, threshold: float, depth: int) -> int:
    """Trees after which a pair exactly at the threshold has met with the target recall at that depth."""
    met = 1.0
    for _ in range(depth):
        p = threshold * met
        met = p + (1 / threshold - 1) * p * (1 - p)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def step(node: np.ndarray, sig: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (row's) node, and the row each belongs to; the same node picks the same coordinates for every document."""
    rows, out, owner = np.arange(len(node)), [], []
    draw = mix64(node ^ np.uint64(0xA0761D6478BD642F))
    first = draw % np.uint64(COORDS)
    other = (first + np.uint64(1) + (draw >> np.uint64(20)) % np.uint64(COORDS - 1)) % np.uint64(COORDS)
    for c, on in ((first, np.ones(len(node), bool)), (other, (draw >> np.uint64(40)) < np.uint64(second * (1 << 24)))):
        out.append(mix64(node[on] * np.uint64(0xE7037ED1A0B428DB) + c[on] * np.uint64(0x8EBC6AF09C88C6E3) ^ sig[rows[on], c[on]].astype(np.uint64)))
        owner.append(rows[on])
    return np.concatenate(out), np.concatenate(owner)


def packed(sig: np.ndarray) -> np.ndarray:
    """BITS bits of each coordinate: (n, 4) uint64."""
    bits = mix64(sig.astype(np.uint64)) >> np.uint64(60)
    two = np.stack([bits & np.uint64(1), (bits >> np.uint64(1)) & np.uint64(1)], 2).astype(np.uint8)
    return np.packbits(two.reshape(len(sig), -1), axis=1).view(np.uint64)


def agreement_floor(similarity: float, sigmas: float = 4.5) -> int:
    """Largest Hamming distance of packed bits that a pair of that similarity keeps to within so many standard errors."""
    var = (similarity * (1 - similarity) / 4 + (1 - similarity) / 8) / COORDS
    return int(COORDS * BITS * (1 - ((1 + similarity) / 2 - sigmas * math.sqrt(var))))


def _fixed(column, dtype, width: int) -> np.ndarray:
    data, offsets = binary(column)
    return data.view(dtype).reshape(-1, width) if len(offsets) > 1 else np.zeros((0, width), dtype)


def binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows, aligned."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = text_bytes(column.cast(pa.binary()).view(pa.string()) if not pa.types.is_string(column.type) else column)
    return np.ascontiguousarray(data) if data.ctypes.data % 8 == 0 else data.copy(), offsets


def _bin(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(docs: DataFrame, words: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key (digest of the set), sig (minwise values); null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a, b = rng.integers(0, 1 << 32, COORDS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, COORDS, np.uint32)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            n, keys, sigs = [], [], []
            for k in range(batch.num_rows):
                s = shingle_set(data[at[k] : at[k + 1]].tobytes(), words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minwise(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _branch(rows: DataFrame, depth: int, second: float, roots: int | None, seed: int) -> DataFrame:
    """Walk depth levels down from the roots (or from the column node) to (node, doc, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sig, doc = _fixed(batch.column("sig"), np.uint32, COORDS), batch.column("doc").to_numpy()
                if roots:
                    node = np.tile(mix64(np.arange(1, roots + 1, dtype=np.uint64) + np.uint64(seed << 20)), len(doc))
                    row = np.repeat(np.arange(len(doc)), roots)
                else:
                    node, row = batch.column("node").to_numpy().view(np.uint64), np.arange(len(doc))
                for _ in range(depth):
                    node, owner = step(node, sig[row], second)
                    row = row[owner]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(doc[row]), _bin(packed(sig)[row])], ["node", "doc", "bits"])

    return rows.mapInArrow(run, "node long, doc long, bits binary")


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def _bits(column) -> np.ndarray:
    return _fixed(column, np.uint64, COORDS * BITS // 64)


def _compare(leaves: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that span what is near inside each node, from nodes of at most NODE_LIMIT members."""
    linked = agreement_floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "node"):
            docs, bits = t.column("doc").to_numpy(), _bits(t.column("bits"))
            starts, sizes = run_bounds(t.column("node").to_numpy())
            for s in np.unique(sizes[sizes > 1]):
                first = starts[sizes == s]
                for at in range(0, len(first), step_ := max(1, 2_000_000 // int(s * s))):
                    here = first[at : at + step_, None] + np.arange(s)
                    x = bits[here]
                    label = spread_labels(_distance(x[:, :, None], x[:, None]) <= linked)
                    k, j = np.nonzero(label != np.arange(s))
                    if len(k):
                        yield pa.RecordBatch.from_arrays([pa.array(docs[here[k, j]]), pa.array(docs[here[k, label[k, j]]])], ["a", "b"])

    parts = shuffle_parts(leaves.sparkSession)
    return leaves.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _against_pivot(rows: DataFrame, threshold: float, last: bool) -> DataFrame:
    """(a, b, node) from members (node, doc, bits, pivot, pivot_bits) of crowded nodes, row by row.

    Edges (member, pivot) have a null node; members b that go deeper have a null a.
    """
    left, could = int(COORDS * BITS * (1 - threshold) / 2), agreement_floor(max(0.0, 2 * threshold - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pivot, node = (batch.column(c).to_numpy() for c in ("doc", "pivot", "node"))
            d = _distance(_bits(batch.column("bits")), _bits(batch.column("pivot_bits")))
            near = ((d <= could) | last) & (docs != pivot)
            n = int(near.sum())
            yield pa.RecordBatch.from_arrays([pa.array(docs[near]), pa.array(pivot[near]), pa.nulls(n, pa.int64())], ["a", "b", "node"])
            stay = (d > left) & (not last)
            n = int(stay.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(docs[stay]), pa.array(node[stay])], ["a", "b", "node"])

    return rows.select("node", "doc", "bits", "pivot", "pivot_bits").mapInArrow(run, "a long, b long, node long")


def start_depth(classes: int) -> int:
    """Levels after which unrelated classes seldom share a node, if a twentieth of them agree in a coordinate."""
    return max(3, math.ceil(math.log(max(1, classes) / NODE_LIMIT) / math.log(20)))


def candidate_groups(reps: DataFrame, classes: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(id, component): groups outside which no two classes of reps (doc, sig) have met in any tree."""
    start = start_depth(classes)
    depth = start + 2
    second, roots = 1 / threshold - 1, tree_count(recall, threshold, depth)
    edges, spent, leaves = [], [], _branch(reps, start, second, roots, seed)
    for level in range(start, depth + 1):
        leaves = stage(leaves, "leaves")
        crowded = leaves.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > NODE_LIMIT).select("node")
        crowded = stage(crowded, "crowded")
        spent += [leaves, crowded]
        if crowded.isEmpty():
            edges.append(stage(_compare(leaves, threshold), "edges"))
            break
        edges.append(stage(_compare(leaves.join(crowded, "node", "left_anti"), threshold), "edges"))
        pivots = leaves.join(crowded, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "bits")).alias("p"))
        pivots = stage(pivots.select("node", F.col("p.doc").alias("pivot"), F.col("p.bits").alias("pivot_bits")), "pivots")
        out = stage(_against_pivot(leaves.join(pivots, "node"), threshold, level == depth), "paths")
        spent += [pivots, out]
        edges.append(out.filter("node is null").select("a", "b"))
        deeper = out.filter("node is not null").select("node", F.col("b").alias("doc"))
        leaves = _branch(deeper.join(reps, "doc"), 1, second, None, seed)
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    groups = stage(connected_components(every), "groups", classes)
    discard(*spent, *edges)
    return groups


def _sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, hashes): the full sets of the wanted ids. A bitmap of bounded size spares most others the hashing; a join drops the rest."""
    size = min(FILTER_BITS, 1 << max(12, (32 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc"), F.lit(size))
    words_ = wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits")).toPandas()
    bitmap = np.zeros(size // 64, np.uint64)
    bitmap[words_["w"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64).view(np.uint64)
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy().astype(np.uint64)
            hit = np.flatnonzero((kept.value[s // np.uint64(64)] >> (s % np.uint64(64))) & np.uint64(1))
            data, at = text_bytes(batch.column("text"))
            for some in np.array_split(hit, max(1, len(hit) // 256)):
                sets = [shingle_set(data[at[k] : at[k + 1]].tobytes(), words).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(some)), pa.array(sets, pa.binary())], ["doc", "hashes"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).select("doc", "text", slot.alias("s"))
    return rows.mapInArrow(run, "doc long, hashes binary").filter("length(hashes) > 0")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, final): each linked document and the smallest label its links reach inside the task of rows (task, side, doc, label, sig, hashes, final).

    side 0 rows are compared with each other and with side 1 rows; side 1 rows not with each other. Rows with equal
    labels are already connected. Pairs whose packed bits rule out the similarity (agreement_floor) are passed over.
    """
    linked = agreement_floor(percent / 100)

    def links(sets: list[np.ndarray], bits: np.ndarray, labels: list[int], side: np.ndarray) -> dict[int, int]:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        order = np.array(sorted(range(len(sets)), key=lambda k: (side[k], -len(sets[k]))))
        for i, p in enumerate(order):
            if side[p]:
                break
            others = order[i + 1 :]
            for q in others[_distance(bits[others], bits[p]) <= linked]:
                x, y = find(labels[p]), find(labels[q])
                if x != y and _linked(sets[p], sets[q], percent):
                    root[max(x, y)] = min(x, y)
        return {v: find(v) for v in root}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "task"):
            starts, sizes = run_bounds(t.column("task").to_numpy())
            labels, side, final = t.column("label").to_pylist(), t.column("side").to_numpy(), t.column("final").to_numpy()
            bits = packed(_fixed(t.column("sig"), np.uint32, COORDS))
            data, at = binary(t.column("hashes"))
            out = []
            for start, size in zip(starts, sizes, strict=True):
                mine = slice(start, start + size)
                sets = [data[at[k] : at[k + 1]].view(np.uint64) for k in range(start, start + size)]
                out += [(a, b, final[start]) for a, b in links(sets, bits[mine], labels[mine], side[mine]).items()]
            if out:
                a, b, done = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(done, pa.int32())], ["a", "b", "final"])

    return rows.repartition(shuffle_parts(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, final int")


def confirmed_components(docs: DataFrame, reps: DataFrame, groups: DataFrame, classes: int, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of the links that full sets confirm inside the candidate groups.

    Groups of at most BLOCK documents are compared at once, which settles them. Of larger ones, first every block with the
    group's first document as pivot; then, block by block, what isn't connected to the largest part yet against everything.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    sized = groups.join(sizes, "component").select(F.col("id").alias("doc"), F.col("component").alias("comp"), blocks.alias("blocks"))
    sized = stage(sized.join(reps, "doc").select("doc", "comp", "blocks", "sig"), "sized")
    sets = _sets(docs, sized, words, id_col, text_col).join(sized, "doc")
    sets = stage(sets.select("doc", "sig", "hashes", "comp", "blocks"), "sets")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(F.lit(0)).cast("int")
    pivots = F.when((F.col("blocks") > 1) & (F.col("doc") == F.col("comp")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    first = sets.select("doc", "sig", "hashes", "comp", "blocks", F.explode(pivots).alias("block"))
    final = (F.col("blocks") == 1).cast("int").alias("final")
    edges = stage(_confirm(first.select(F.xxhash64("comp", "block").alias("task"), F.lit(0).alias("side"), "doc", F.col("doc").alias("label"), "sig", "hashes", final), percent), "links")
    settled = edges.filter("final = 1").select(F.col("a").alias("id"), F.col("b").alias("component"))
    if sized.filter("blocks > 1").isEmpty():
        return settled
    edges = edges.filter("final = 0").select("a", "b")
    comps = stage(connected_components(edges), "parts", classes)
    parts = sets.filter("blocks > 1").join(comps.withColumnRenamed("id", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    count = parts.groupBy("comp", "label").agg(F.count("*").alias("n"))
    count = count.groupBy("comp").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    count = stage(count.filter("most < n").select("comp", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("rest")), "main", classes // BLOCK)
    if not count.isEmpty():
        # A rest block meets each block of the main part, each other rest block and itself.
        p = parts.join(count, "comp").withColumn("in_main", F.col("label") == F.col("main"))
        p = p.withColumn("part", F.pmod(F.xxhash64("doc"), F.when(F.col("in_main"), F.col("blocks")).otherwise(F.col("rest"))).cast("int"))
        kept = ["comp", "doc", "label", "sig", "hashes"]
        each = F.explode(F.sequence(F.lit(0), F.col("rest") - 1))
        main_side = p.filter("in_main").select(*kept, each.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), F.lit(True).alias("main"))
        rest_main = p.filter("not in_main").select(*kept, F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), F.lit(True).alias("main"))
        rest_rest = p.filter("not in_main").select(*kept, "part", each.alias("o")).select(*kept, F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), F.lit(0).alias("side"), F.lit(False).alias("main"))
        rows = main_side.union(rest_main).union(rest_rest).select(F.xxhash64("comp", "i", "j", "main").alias("task"), "side", "doc", "label", "sig", "hashes", F.lit(0).alias("final"))
        more = stage(_confirm(rows, percent), "links")
        comps = connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    return settled.union(comps)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.999, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are runs without space, tab or line breaks, with A-Z in lower case; a document's set holds its distinct word
    shingles (all words as one, where there are fewer). Documents are linked if 100 * intersection >= percent * union of
    their sets. Recall is the chance that a pair exactly at the threshold meets in a tree; closer pairs meet likelier.

    Null, empty and blank texts have an empty set and are linked with nothing. A row without an id is linked with
    nothing, has a null component_id and is kept. Rows that share an id are one document with several texts and give a
    row each. An empty table gives no rows. Other columns of docs are ignored. Texts are read whole, whatever their length.
    """
    rows = stage(sketch(docs, words, seed, id_col, text_col), "sketch")
    sig = rows.filter("doc_id is not null and set_key is not null")
    reps = stage(sig.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")), "classes")
    same = sig.select(F.col("doc_id").alias("a"), "set_key").join(reps.select("set_key", F.col("doc").alias("b")), "set_key")
    classes = reps.count()
    groups = candidate_groups(reps.select("doc", "sig"), classes, percent / 100, recall, seed)
    comps = confirmed_components(docs, reps.select("doc", "sig"), groups, classes, words, percent, id_col, text_col)
    shared = sig.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").select("doc_id")
    if not shared.isEmpty():  # an id with several texts connects their classes
        bridge = same.join(shared.withColumnRenamed("doc_id", "a"), "a", "left_semi").select("a", "b")
        comps = connected_components(bridge.union(comps.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    named = stage(reps.select("set_key", "doc").join(comps.withColumnRenamed("id", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component")), "named", classes)
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which one stays in each group of near duplicates: that with the smallest id.

    Of rows that repeat an id, the one with the smallest text hash stays (then the smallest hash of the row as JSON); rows
    without an id stay. Columns keep their names, types and values, whatever those are. An empty table stays empty.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept and doc_id is not null")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("h"))
    every = [F.col("row")[c].alias(c) for c in docs.columns]
    known = rows.filter("id is not null").join(kept.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    repeated = stage(known.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    loose = rows.filter("id is null").select(every)
    if repeated.isEmpty():
        return known.select(every).union(loose)
    order = F.struct("h", F.xxhash64(F.to_json("row")))
    first = known.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row"))
    return known.join(repeated, "id", "left_anti").select(every).union(first.select(every)).union(loose)
