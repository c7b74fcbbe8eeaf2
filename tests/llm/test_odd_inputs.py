"""Every operator and pipeline stage on tables with nulls, empty and very long texts, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnloom.llm import embeddings, fingerprint, langid, minhash, mixing, packing, quality, queries, secrets, toxicity, warc
from tarnloom.llm.common import table

SF = "/root/testdata/sf0.001"
CLASH = ("h", "taken", "_row", "row", "part", "key", "salt", "node", "label", "score", "bin", "_found", "n", "y", "id", "words", "letters", "extra", "epoch", "H2")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the small table and odd rows, all with extra columns that operators might use themselves."""
    docs = table(spark, SF, "documents")
    long = "A plain sentence of words, token=abcdef12345 and more. " * 90_000
    assert len(long) > 4_900_000
    rows = [(None, None, None, None, None), (900_001, "", "en", "src1", 0), (900_001, "", "en", "src1", 0), (900_002, " \n", None, "src1", 3), (900_003, long, "en", "src2", len(long)), (None, "no id here", "en", None, 10), (None, "no id here", "en", None, 10), (900_004, "1d" * 30_000, "en", "src1", 60_000)]
    more = docs.limit(60).union(spark.createDataFrame(rows, docs.schema))
    extra = {c: F.lit(1) for c in CLASH} | {"a.b": F.lit("x"), "tags": F.create_map(F.lit("k"), F.lit("v")), "nothing": F.lit(None).cast("string")}
    return more.withColumns(extra).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels").withColumns({"text": F.lit(1), "h": F.lit(2), "id": F.lit(3)})


def _op(name, spark, docs, labels):
    return {
        "op1": lambda: packing.pack(docs),
        "op1s": lambda: packing.sequences(docs),
        "op2": lambda: quality.score_quality(docs, labels),
        "op3": lambda: secrets.scan(docs, [0.0] * len(secrets.ALPHABET) ** 2),
        "op4": lambda: mixing.mix(docs, queries.source_tree(), [{}, {}, {}]),
        "op5": lambda: warc.round_trip(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[c for c in CLASH if c != "key"])),
        "op6": lambda: langid.identify(docs, langid.fit(docs)),
        "op7": lambda: minhash.near_duplicates(docs, words=2),
        "op8": lambda: toxicity.score_toxicity(docs, toxicity.fit(docs, labels)),
        "op9": lambda: fingerprint.fingerprint_edits(docs),
    }[name]()


@pytest.mark.parametrize("name", ["op1", "op1s", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_operators_on_odd_documents(spark, odd, labels, name):
    got = _op(name, spark, odd, labels).cache()
    n = odd.count()
    if name in ("op2", "op3", "op5", "op6", "op7", "op8", "op9"):
        assert got.count() == n
    elif name == "op1":
        tokens = odd.select(F.sum(packing.words())).first()[0]
        assert got.agg(F.sum("n_tokens")).first()[0] == tokens and got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    elif name == "op1s":
        bins = got.collect()
        assert all(sum(r["lengths"]) == r["bin_used"] == len(r["tokens"]) <= r["bin_size"] for r in bins)
        words = [w for r in odd.select("text").collect() for w in (r["text"] or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
        assert sorted(w for r in bins for w in r["tokens"]) == sorted(words)
    assert _op(name, spark, odd.limit(0), labels.limit(0)).count() == 0
    got.unpersist()


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (3, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("v", "key", "id", "a", "b", "n", "copies")})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddings.near_vectors(frame).collect()), key=str)
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


@pytest.mark.parametrize("place", range(5))
def test_pipeline_stages_on_odd_documents(spark, odd, place):
    name, function = corpus_pipeline.STAGES[place]
    out = function(spark, odd, SF)
    if name != "packing":
        assert out.dtypes == odd.dtypes
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 900_003 in ids and (name == "mixing" or {900_001, 900_002, None} <= ids)
    assert function(spark, odd.limit(0), SF).count() == 0
