"""Column functions on strings: cleaning, identifiers, metrics, symbols and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITELIST = "ACDEFGHIKLMNPQRSTVWY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str, whitelist: str = WHITELIST) -> Column:
    """Upper case without spaces, gaps and anything off the whitelist."""
    return F.regexp_replace(F.upper(F.trim(_col(c))), f"[^{whitelist}]", "")


def ungapped(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_col(c), "-", ""))


def clean_id(c: Column | str) -> Column:
    """The second bar-separated field of `sp|..` and `tr|..` ids, else the first word."""
    c = _col(c)
    return F.when(c.rlike(r"^(sp|tr)\|"), F.split_part(c, F.lit("|"), F.lit(2))).otherwise(F.split_part(F.trim(c), F.lit(" "), F.lit(1)))


def sanitise_id(c: Column | str) -> Column:
    """First word, with bars and dots as underscores."""
    return F.translate(F.split_part(F.trim(_col(c)), F.lit(" "), F.lit(1)), "|.", "__")


def safe_name(c: Column | str, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(_col(c), r"[^A-Za-z0-9_\-.]", "_"), 1, longest)


def strip_version(c: Column | str) -> Column:
    return F.split_part(_col(c), F.lit("."), F.lit(1))


def formatted_key(method: Column | str, index: Column | str, robust: Column | str, baseline: Column | str) -> Column:
    two = lambda c: F.call_function("format_number", _col(c), F.lit("0.00"))  # rounds the exact binary value
    return F.concat(F.format_string("%s_%04d_rb", _col(method), _col(index)), two(robust), F.lit("_wt"), two(baseline))


def parse_metric(c: Column | str) -> Column:
    """`key:value` as struct(key, i, d, s): integer, else double, else string; null without a colon or with an empty key."""
    c = _col(c)
    key, value = F.regexp_extract(c, r"^([^:]*):", 1), F.regexp_extract(c, r"^[^:]*:(.*)$", 1)
    whole = value.rlike(r"^[-+]?\d+$")
    i, d = F.when(whole, value.try_cast("bigint")), F.when(~whole, value.try_cast("double"))
    fields = F.struct(key.alias("key"), i.alias("i"), d.alias("d"), F.when(i.isNull() & d.isNull(), value).alias("s"))
    return F.when(c.contains(":") & (F.length(key) > 0), fields)


def encode_symbols(c: Column | str, alphabet: str = WHITELIST) -> Column:
    """Position of each character in the alphabet; the alphabet's length for any other."""
    place = lambda x: F.when(F.instr(F.lit(alphabet), x) > 0, F.instr(F.lit(alphabet), x) - 1).otherwise(len(alphabet))
    return F.transform(F.split(_col(c), ""), lambda x: place(x).cast("smallint"))


def decode_tokens(c: Column | str, alphabet: str = WHITELIST, offset: int = 4) -> Column:
    """Symbols of token ids: ids within the alphabet as they are, ids above it less the offset; others are skipped."""
    n = len(alphabet)
    known = F.filter(_col(c), lambda x: (x >= 0) & (x < n + offset))
    return F.array_join(F.transform(known, lambda x: F.substring(F.lit(alphabet), F.when(x < n, x + 1).otherwise(x - offset + 1).cast("int"), F.lit(1))), "")


def translate_triplets(c: Column | str, table: dict[str, str], unknown: str = "X", stop: str = "*") -> Column:
    """Symbol of each whole group of three characters; a rest is dropped, one stop at the end removed."""
    c = _col(c)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / 3).cast("int") - 1), lambda i: F.coalesce(F.try_element_at(lookup, F.substring(c, i * 3 + 1, F.lit(3))), F.lit(unknown)))
    return F.regexp_replace(F.when(F.length(c) >= 3, F.array_join(parts, "")).when(c.isNotNull(), ""), f"\\{stop}$", "")


def translate_to_stop(c: Column | str, table: dict[str, str], stop: str = "*") -> Column:
    """As translate_triplets, up to the first stop."""
    return F.substring_index(translate_triplets(c, table, stop=stop), stop, 1)


def distance(a: Column | str, b: Column | str) -> Column:
    """Mismatches on the common prefix plus the difference in length; null if either is."""
    a, b = _col(a), _col(b)
    chars = lambda x: F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    differ = F.zip_with(chars(a), chars(b), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def distance_truncated(a: Column | str, b: Column | str) -> Column:
    """Mismatches on the common prefix alone."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    return distance(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n))


def prefix_domain(c: Column | str, n: int, stop: str = "*") -> Column:
    """The first n characters, if there are n and none is a stop; else null."""
    head = F.substring(_col(c), 1, n)
    return F.when((F.length(head) == n) & ~head.contains(stop), head)
