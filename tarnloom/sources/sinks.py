"""Sinks: text records, CSV, Markdown, JSON, and results that are reused if they exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import shown
from ..operators.ranking import number_rows


def write_records(df: DataFrame, path: str, record_id: str = "id", body: str = "body", width: int = 60) -> None:
    """`>id` and the body in lines of `width` characters."""
    wrapped = F.regexp_replace(F.col(body), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.format_string(">%s\n%s", F.col(record_id).cast("string"), wrapped).alias("value")).write.text(path)


def write_listed(df: DataFrame, ids: DataFrame, path: str, record_id: str = "id", body: str = "body") -> int:
    """Write the records of the listed ids (id, ordinal) in list order; missing ones are skipped. Returns how many."""
    found = ids.join(df, record_id).orderBy("ordinal").select(record_id, body)
    write_records(found, path, record_id, body)
    return ids.join(df, record_id, "left_semi").count()


def preferred_order(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, then the others as they stand; nested ones as JSON text."""
    names = [c for c in preferred if c in df.columns] + [c for c in df.columns if c not in preferred]
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in names])


def write_csv(df: DataFrame, path: str, preferred: list[str] | None = None) -> None:
    preferred_order(df, preferred or []).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def _cells(df: DataFrame, decimals: int) -> list[Column]:
    """Each column as text; floats to so many decimals, null and NaN as a dash."""
    is_float = {f.name: f.dataType.typeName() in ("double", "float") for f in df.schema.fields}
    return [shown(F.col(c), decimals) if is_float[c] else F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns]


def markdown_rows(df: DataFrame, decimals: int = 3) -> DataFrame:
    """(line): each row as a table line."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(df, decimals)), F.lit(" |")).alias("line"))


def markdown_lines(df: DataFrame, order: list[Column], decimals: int = 3) -> DataFrame:
    """(place, line): header (0), rule (1) and rows (from 2, in that order) of a table with cells padded to their column's width."""
    numbered = number_rows(df, order, "_place")
    names = [f"c{k}" for k in range(len(df.columns))]
    text = numbered.select((F.col("_place") + 1).alias("place"), *[c.alias(n) for c, n in zip(_cells(numbered.drop("_place"), decimals), names, strict=True)])
    widths = text.agg(*[F.greatest(F.coalesce(F.max(F.length(n)), F.lit(0)), F.lit(len(c))).alias(f"w{n}") for n, c in zip(names, df.columns, strict=True)])  # one row
    header = widths.select(F.lit(0).cast("long").alias("place"), *[F.lit(c).alias(n) for n, c in zip(names, df.columns, strict=True)], *widths.columns)
    body = header.union(text.crossJoin(F.broadcast(widths)))
    padded = lambda n: F.rpad(F.col(n), F.greatest(F.col(f"w{n}"), F.length(n)), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[padded(n) for n in names]), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.concat_ws("|", *[F.repeat(F.lit("-"), F.col(f"w{n}") + 2) for n in names]), F.lit("|"))
    return body.select("place", line.alias("line")).union(widths.select(F.lit(1).cast("long"), rule))


def markdown_table(df: DataFrame, decimals: int = 3, most: int = 1000) -> str:
    """The table as text for a report; ValueError if it has more rows than a report can show."""
    lines = [r["line"] for r in markdown_rows(df, decimals).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows")
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'|'.join(' --- ' for _ in df.columns)}|", *lines])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result written at the path; it is made first only if a complete one isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_manifest(spark: SparkSession, path: str, entry: dict[str, str]) -> None:
    """Append one line of tab-separated key=value."""
    line = "\t".join(f"{k}={v}" for k, v in entry.items())
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
