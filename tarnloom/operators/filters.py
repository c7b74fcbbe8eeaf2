"""Predicates on records, scores and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distance_truncated


def length_between(body: str, low: int, high: int) -> Column:
    return F.length(body).between(low, high)


def complete(body: str, least: int, stop: str = "*") -> Column:
    """At least so long without gaps and unknowns, and no stop."""
    bare = F.regexp_replace(body, "[-X]", "")
    return (F.length(bare) >= least) & ~F.col(body).contains(stop)


def near_reference(body: str, reference: Column, width: int, low: int, high: int, unknown: str = "X") -> Column:
    """Exactly so long, nothing unknown, and a distance from the reference within bounds (inclusive)."""
    return (F.length(body) == width) & ~F.col(body).contains(unknown) & distance_truncated(F.col(body), reference).between(low, high)


def keyword(columns: list[str], word: str) -> Column:
    """Whether the concatenated columns hold the word, whatever its case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(word.lower())


def at_least(score: str, threshold: float) -> Column:
    return F.coalesce(F.col(score), F.lit(0.0)) >= threshold


def present(score: str) -> Column:
    return F.col(score).isNotNull()


def not_nan(score: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(score)


def tag_starts(tag: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(tag).startswith(p)
    return out


def tag_stripped(tag: str, prefix: str) -> Column:
    return F.when(F.col(tag).startswith(prefix), F.substring(F.col(tag), F.lit(len(prefix) + 1), F.length(tag))).otherwise(F.col(tag))


def labelled(df: DataFrame, labels: DataFrame, tag: str) -> DataFrame:
    """Rows whose tag has a label."""
    return df.join(labels, tag, "left_semi")


def at_least_rows(df: DataFrame, least: int = 20) -> DataFrame:
    """df itself; ValueError if it has fewer rows. Only as many rows are counted as needed."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return df


def name_parts(name: str, pattern: str, groups: list[str]) -> list[Column]:
    """Capture groups of the pattern as columns; filter on F.col(name).rlike(pattern) first."""
    return [F.regexp_extract(name, pattern, k + 1).alias(g) for k, g in enumerate(groups)]
