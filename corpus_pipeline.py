"""Documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnloom.llm import minhash, mixing, packing, queries, secrets, toxicity
from tarnloom.llm.common import free_name, stage, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay unless nothing but toxic rows was learned."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    Null and empty texts and rows without an id stay; of rows that repeat an id one stays.
    """
    return minhash.deduplicated(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret; null texts stay null."""
    return secrets.redact(docs, secrets.fit_ratios(secrets.corpus_samples(docs).union(secrets.rule_samples(docs))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each leaf's token-prefix under the target weights, in one epoch.

    The last one of a prefix stays whole. Documents without tokens go. Rows that share an id, or have none, stay if one of
    them is taken.
    """
    weights = [queries.DOMAIN_WEIGHTS, queries.LANG_WEIGHTS, queries.SOURCE_WEIGHTS]
    name = free_name(docs, "taken")
    mixed = mixing.mix(docs, queries.source_tree(), weights, share=(9, 10), epochs=1)
    taken = mixed.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; a document without tokens has a row without a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, the Markov models and packing have no SQL form; tests/llm compares each stage's rows with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
