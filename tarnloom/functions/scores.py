"""Column functions on scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_COLUMNS = ("wt_score", "robust_score", "mean_score", "min_score")


def min_max(c: Column, low: float = 7.0, high: float = 9.0, mode: str = "minmax") -> Column:
    """(c - low) / (high - low), clamped to 0..1; mode raw leaves it as it is."""
    if mode == "raw":
        return c
    if high <= low:
        raise ValueError("high must be above low")
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low))))


def normalise_rows(df: DataFrame, low: float = 7.0, high: float = 9.0, columns: tuple[str, ...] = SCORE_COLUMNS, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Scale score columns and array elements, keep the old values as raw_*, and stamp the range."""
    raw = {f"raw_{c}": F.col(c) for c in (*columns, *arrays)}
    scaled = {c: min_max(F.col(c), low, high) for c in columns} | {a: F.transform(a, lambda x: min_max(x, low, high)) for a in arrays}
    return df.withColumns(raw).withColumns(scaled).withColumns({"score_low": F.lit(low), "score_high": F.lit(high), "score_mode": F.lit("minmax")})


def lower_tail_mean(scores: Column, eta: float, clip: bool = True) -> Column:
    """Mean of the max(1, floor(eta * n)) smallest elements; NaN for an empty array. Nulls are left out."""
    eta = min(1.0, max(1e-6, eta)) if clip else eta
    s = F.array_sort(F.filter(scores, lambda x: x.isNotNull()))
    k = F.greatest(F.lit(1), F.floor(F.lit(float(eta)) * F.size(s))).cast("int")
    total = F.aggregate(F.slice(s, F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(s) == 0, F.lit(float("nan"))).otherwise(total / k)


def mean_of(values: Column) -> Column:
    """Mean of a list; null for an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def rejection(requested: Column, accepted: Column) -> Column:
    """struct(rejected, rate): max(0, requested - accepted), and its share or NaN where nothing was requested."""
    rejected = F.greatest(F.lit(0), requested - accepted)
    return F.struct(rejected.alias("rejected"), F.when(requested == 0, F.lit(float("nan"))).otherwise(rejected / requested).alias("rate"))


def default_threshold(scaled: bool) -> float:
    return 0.5 if scaled else 8.0


def shown(c: Column, decimals: int = 3) -> Column:
    """Text of a number for reports; null and NaN are a dash."""
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.call_function("format_number", c, F.lit("0." + "0" * decimals if decimals else "0")))
