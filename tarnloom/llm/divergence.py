"""Divergence between the sources of each language, from wide term vectors.

Every kept term becomes an array with a place for each source of its language. Higher-order functions turn an array into
shares and into the differences of each pair of sources; the differences are summed on the map side, so a shuffle carries
one row a pair and task whatever the number of terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_bytes

SCALE, PRIOR = 1_000_000_000, 5
MOST_HELD = 400_000  # terms whose counts a task holds
BLOCK = 4 << 20  # bytes of a text that are cut into words at once
#: Each byte of a term to itself, A-Z to a-z, every other byte to a space.
_LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k > 127 else 32 for k in range(256))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers.

    SCALE is 1000 three times over; dividing one thousand at a time stays exact while total + PRIOR * terms is below 9 * 10^15.
    """
    below, rest = total + PRIOR * terms, count + PRIOR
    out: Column = F.lit(0).cast("long")
    for _ in range(3):
        top = rest * F.lit(1000).cast("long")
        rest = F.pmod(top, below)
        out = out * F.lit(1000).cast("long") + F.call_function("div", top, below)
    return out + 1


def _flushed(lang: str, source: str, n: Counter, docs: Counter) -> pa.RecordBatch:
    names = pa.array(n.keys(), pa.binary()).view(pa.string())
    numbers = [pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), names, *numbers], ["lang", "source", "term", "n", "docs"])


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from one pass over the texts: occurrences, and documents with the term.

    A task adds up what it reads before anything is shuffled and passes its counts on when it holds MOST_HELD terms. On bytes,
    a term is a run of letters a-z and of bytes above 127; a text is cut into blocks between terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                text, seen, cut = data[at[k] : at[k + 1]].tobytes().translate(_LETTERS), set(), 0
                while cut < len(text):
                    end = len(text) if len(text) - cut <= BLOCK else text.find(b" ", cut + BLOCK)
                    words = text[cut : end if end >= 0 else len(text)].split()
                    new = set(words) - seen
                    seen |= new
                    n, docs = held[group]
                    size -= len(n)
                    n.update(words)
                    docs.update(new)
                    size += len(n)
                    cut = end if end >= 0 else len(text)
                    if size >= MOST_HELD:
                        yield from (_flushed(*g, *c) for g, c in held.items())
                        held.clear()
                        size = 0
        yield from (_flushed(*g, *c) for g, c in held.items())

    counted = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(
    docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Terms are those in at least least_docs documents of their language. Part `pair` ranks the language's other sources by the
    sum of absolute differences of shares over those terms; part `term` ranks the source's own terms whose share is above the
    language's, up to most_terms. Ties go by the bytes of the item. Null text, language and source count as ''. A group
    without terms still has its pairs (value 0 where its language keeps no term). Repeated rows are documents of their own, an
    empty table gives no rows, other columns are ignored and texts are read whole.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stage(rows.select("lang", "source").distinct().withColumn("place", place), "groups")

    placed = term_counts(rows).join(groups, ["lang", "source"])
    entries = F.collect_list(F.struct("place", "n")).alias("entries")  # at most one for each source
    gathered = placed.groupBy("lang", "term").agg(entries, F.sum("docs").alias("docs"))  # a document has one source
    kept = stage(gathered.filter(F.col("docs") >= least_docs).drop("docs"), "kept")

    sums = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.place").alias("place")).agg(F.sum("e.n").alias("total"))
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    own = F.array_sort(F.collect_list(F.struct("place", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))))
    langs = groups.join(sums, ["lang", "place"], "left").groupBy("lang").agg(own.alias("g")).join(n_terms, "lang", "left")
    total = F.aggregate("g.total", F.lit(0).cast("long"), lambda a, x: a + x)
    langs = stage(langs.select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), total.alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "langs")

    count_at = F.map_from_entries("entries")
    wide = kept.join(langs, "lang").withColumn("counts", F.transform("totals", lambda _, k: F.coalesce(F.element_at(count_at, k), F.lit(0).cast("long"))))
    wide = wide.withColumns({
        "shares": F.zip_with("counts", "totals", lambda c, t: share(c, t, F.col("n_terms"))),
        "of_lang": share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.col("total"), F.col("n_terms")),
    })

    left = wide.select("lang", "shares", F.posexplode("shares").alias("a", "x"))
    rest = F.expr("slice(shares, a + 2, size(shares))")
    pairs = left.select("lang", "a", F.posexplode(F.transform(rest, lambda y: F.abs(y - F.col("x")))).alias("k", "f"))
    pairs = pairs.groupBy("lang", "a", (F.col("a") + 1 + F.col("k")).alias("b")).agg(F.sum("f").alias("f"))
    first = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    every = first.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    pairs = every.join(pairs.union(pairs.select("lang", "b", "a", "f")), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))

    above = F.filter(F.arrays_zip("sources", "counts", "shares"), lambda e: (e["counts"] > 0) & (e["shares"] > F.col("of_lang")))
    terms = wide.select("lang", "term", "of_lang", F.explode(above).alias("e"))
    terms = terms.select("lang", F.col("e.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("e.shares") - F.col("of_lang")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= most_terms)  # each task passes on most_terms rows a group
    return pairs.withColumn("rank", rank).unionByName(terms)
