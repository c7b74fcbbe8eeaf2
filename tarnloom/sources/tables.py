"""JSON and CSV results: envelopes unwrapped and columns pruned while parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .json_ranges import objects_of, scan_objects
from .text_records import with_ordinal

RESULT = "method string, peptide string, wt_score double, robust_score double, mean_score double, min_score double, retention_score double, omega array<double>"
WHOLE = 32 << 20  # bytes of a JSON file that one task reads
ENVELOPES = ("designs", "per_peptide", "rows")


def scan_results(spark: SparkSession, path: str, item: str = RESULT, whole: int = WHOLE) -> DataFrame:
    """One row for each result, with source_file: from a list, or from the first of ENVELOPES that an object has; other objects give none.

    Elements that are no objects are dropped, and count for source_line. Fields that the schema doesn't name, such as large
    score arrays, are skipped by the parser. Each file is one JSON value; one that is broken gives nothing.
    Files of at most `whole` bytes are read as one text; larger ones by all tasks that their splits go to.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in files.filter(F.col("length") > whole).select("path").collect()]  # few: each is large
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value", F.col("_metadata.file_size").alias("size"))
    each = objects_of(raw.filter(F.col("size") <= whole), ENVELOPES)
    if large:
        each = each.union(scan_objects(spark, large, ENVELOPES))
    return each.select("source_file", "source_line", F.from_json("value", f"struct<{item}>").alias("r")).select("source_file", "source_line", "r.*")


def scan_scored_json(spark: SparkSession, path: str) -> DataFrame:
    """(item, target, source_file, source_line): item from `peptide`, else `sequence`; rows without one are dropped."""
    rows = scan_results(spark, path, "peptide string, sequence string, target string")
    return rows.select(clean_text(F.coalesce("peptide", "sequence")).alias("item"), clean_text("target").alias("target"), "source_file", "source_line").filter("length(item) > 0")


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blank cells null, with source_file and ordinal."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cells = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))) for c in df.columns}
    return with_ordinal(df).select(*[v.alias(k) for k, v in cells.items()], "source_file", "ordinal")


def typed_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as struct(i, d, s): integer, else double, else string; null where the cell is."""
    out = {}
    for c in columns:
        whole = F.col(c).rlike(r"^[-+]?\d+$")
        i, d = F.when(whole, F.col(c).try_cast("bigint")), F.when(~whole, F.col(c).try_cast("double"))
        out[c] = F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), d.alias("d"), F.when(i.isNull() & d.isNull(), F.col(c)).alias("s")))
    return df.withColumns(out)


def first_named(df: DataFrame, names: tuple[str, ...], alias: str) -> DataFrame:
    """df with `alias`: the first non-empty of those of the named columns that df has; ValueError if it has none."""
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of {', '.join(names)} found")
    return df.withColumn(alias, F.coalesce(*[F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in have]))


def probe_json(df: DataFrame, column: str, key: str, nested: tuple[str, ...] = ()) -> DataFrame:
    """df with `found`: the key's value at the top of a JSON text, in the first element of a list, or in a nested object."""
    paths = [f"$.{key}", f"$[0].{key}", *[f"$.{n}.{key}" for n in nested]]
    return df.withColumn("found", F.coalesce(*[F.get_json_object(column, p) for p in paths]))
