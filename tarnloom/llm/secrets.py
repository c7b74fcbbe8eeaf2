"""Secret scans with DataFrame functions only: three fixed patterns, and Markov models of random strings and identifiers.

First-order character models of labelled random strings and ordinary identifiers are counted from a bounded sample: digests
in several alphabets on one side; words, and names of words in the usual forms, on the other. A token whose log-likelihood
ratio is high enough is one more secret, unless it overlaps a fixed span. UUIDs are names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, quoted

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ with 20 or more characters
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ with 24 or more characters
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_-]{16,}"  # what the models are asked about
SAMPLE_TOKEN = r"\b[A-Z]?[a-z]{7,}\b"  # words of the corpus that are learned as identifiers
#: A UUID names something; it counts as an identifier whatever its digits.
UUID = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MAX_TRAIN_DOCS = 4_000  # documents whose tokens are learned from, chosen by hash
MIN_RATIO = 10.0  # nats by which a token must be likelier as a random string; set by error rates on other words (README)
MASK = "[secret]"


#: Ordinary words that labelled identifiers are made of.
WORDS = """
active address agent amount apply archive array attempt backup batch body branch build bundle cache call change
channel clock close code color commit compare config console content context copy cover delete dynamic edit element
email encode entry example exchange export extra factory failure fetch field filter folder frame global graph handle
hash header helper host image import index inner instance internal kernel last layer leader limit list listener lock
machine mapper mask matrix member mode model mount object online open other outer part password pattern picture pixel
place player point policy prefix preview previous process product profile protocol query reference register release
remote remove render replace request resolve resource response return reverse root route sample scale schedule scope
second section sender serial service share short simple slice snapshot socket stack stage static step storage style
submit summary switch symbol system test token total trace tree trigger upload user util variable vector video view
warning watch weight width window worker year
""".split()

CHUNK = 256  # numbers of a running sum or maximum that are appended one by one
SPANS = "array<struct<start:int,end:int,kind:string,value:string,byte:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _once(use: Callable[..., Column], **values: Column) -> Column:
    """use(values) with each value computed once and held by reference.

    A column that a lambda names is not enough: the optimiser may put its expression in the column's place, to be computed
    for each element, and a binary column is copied each time it is read.
    """
    held = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(held, lambda x: use(*[x[k] for k in values])), 0)


def _running(values: Column, best: bool = False) -> Column:
    """For an array of at least one int, the sum (or maximum, from 0) of what stands before each, and of all at the end.

    Chunks of CHUNK numbers are run through on their own and then moved by what the chunks before them give, so the work
    grows with the array instead of its square.
    """
    join = F.greatest if best else lambda a, b: a + b
    run = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))
    last = lambda a: F.element_at(a, -1)

    def chunked(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int") - 1)
        return F.transform(places, lambda k: run(F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))

    def moved(chunks: Column, before: Column) -> Column:
        move = lambda c, k: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: join(x, F.get(before, k)))
        return F.concat(F.flatten(F.transform(chunks, move)), F.array(last(before)))

    with_totals = lambda c: _once(moved, c=c, m=run(F.transform(c, last)))
    return _once(lambda v: _once(with_totals, c=chunked(v)), v=values)


def _spans(df: DataFrame, kind: str, pattern: str, text: str, gate: Column | None = None) -> DataFrame:
    """Add the column `kind`: SPANS of the pattern's matches in the column text, in code points, end exclusive.

    The pieces between matches give the positions; they are only cut where there is a match, and matches only sought where
    the gate is open. `byte` is where a span begins in UTF-8. A span holds ASCII only.
    """
    matches = _matches(F.col(text), pattern)
    df = df.withColumn("_found", F.when(gate, matches) if gate is not None else matches)

    def with_positions(found: Column, cut: Column, value: Column) -> Column:
        sizes = lambda size: F.zip_with(F.slice(cut, F.lit(1), F.size(found)), found, lambda c, m: size(c) + F.length(m))

        def spans(at: Column, byte: Column) -> Column:
            return F.transform(found, lambda m, k: F.struct(
                (F.get(at, k) + F.length(F.get(cut, k))).alias("start"), F.get(at, k + 1).alias("end"), F.lit(kind).alias("kind"),
                F.get(value, k).alias("value"), (F.get(byte, k) + F.octet_length(F.get(cut, k))).alias("byte"),
            ))

        return _once(spans, at=_running(sizes(F.length)), byte=_running(sizes(F.octet_length)))

    value = _matches(F.col(text), pattern, 2) if kind == "assign" else F.col("_found")
    every = _once(with_positions, found=F.col("_found"), cut=F.split(F.col(text), pattern, -1), value=value)
    if kind == "assign":  # a match that is too short still takes its text, so it is dropped only now
        every = F.filter(every, lambda s: F.length(s["value"]) >= 6)
    return df.withColumn(kind, F.when(F.size("_found") > 0, every).otherwise(F.array().cast(SPANS))).drop("_found")


def _base_spans(df: DataFrame) -> DataFrame:
    """Columns assign, access and hex added to (_row, _text). An access key or a hexadecimal run is part of a long token."""
    text = F.col("_text")
    df = df.withColumn("_token", F.coalesce(text.rlike(TOKEN), F.lit(False)))
    df = _spans(df, "assign", ASSIGN, "_text", F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    df = _spans(df, "access", ACCESS, "_text", F.col("_token") & F.contains(text, F.lit("AKIA")))
    return _spans(df, "hex", HEX, "_text", F.col("_token"))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with each of the spans (which may overlap) replaced, null where there is none.

    fill gives what stands for a span, from its start, its end and the end of all spans before it. The text is cut as bytes, so
    a cut costs what it takes, wherever it lies.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["byte"].alias("byte"))))

    def cut(raw: Column, s: Column, to: Column, to_byte: Column) -> Column:
        part = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        gap = lambda x, k: F.when(x["byte"] > F.get(to_byte, k), part(F.get(to_byte, k), x["byte"])).otherwise("")
        pieces = F.transform(s, lambda x, k: F.concat(gap(x, k), fill(x["start"], x["end"], F.get(to, k))))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(to_byte, -1), F.octet_length(raw)))

    def with_ends(s: Column) -> Column:
        to = _running(F.transform(s, lambda x: x["end"]), best=True)
        to_byte = _running(F.transform(s, lambda x: x["byte"] + x["end"] - x["start"]), best=True)
        return _once(cut, raw=text.cast("binary"), s=s, to=to, to_byte=to_byte)

    return F.when(F.size(spans) > 0, _once(with_ends, s=order))


def _identifiers(words: Column, h: Column) -> Column:
    """An identifier of these words, in the form that the hash h picks; a third end in a number."""
    number = F.pmod(F.shiftright(h, 8), F.lit(10_000)).cast("string")
    parts = F.when(F.pmod(F.shiftright(h, 24), F.lit(3)) == 0, F.concat(words, F.array(number))).otherwise(words)
    large = F.transform(parts, F.initcap)
    camel = F.concat(F.get(parts, 0), F.array_join(F.slice(large, F.lit(2), F.size(large)), ""))
    day = F.concat_ws("-", F.lit("20"), F.lpad(F.pmod(h, F.lit(97)).cast("string"), 2, "0"), number)
    forms = [
        F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(parts, "/"), F.array_join(parts, ""), camel, F.array_join(large, ""), F.array_join(large, "-"),
        F.upper(F.array_join(parts, "_")), F.concat(F.get(parts, 0), F.lit("_"), day), F.concat(day, F.abs(h).cast("string")),
    ]
    return F.get(F.array(*forms), F.pmod(F.shiftright(h, 40), F.lit(len(forms))).cast("int"))


def rule_samples(docs_frame: DataFrame, n: int = 600) -> DataFrame:
    """(token, random) made by rule: digests in seven alphabets, labelled random, and identifiers of WORDS in ten forms."""
    ids = docs_frame.sparkSession.range(n)
    h = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    wide = F.base64(F.unhex("h"))
    forms = F.transform(F.array(
        F.col("h"), F.upper("h"), F.translate(wide, "=", ""), F.translate(wide, "+/=", "-_"), F.translate(wide, "+/=", ""), F.upper(F.translate(wide, "+/=", "")), F.lower(F.translate(wide, "+/=", "")),
    ), lambda t: F.substring(t, 1, 40))
    random = ids.select(h.alias("h")).select(F.explode(forms).alias("token"), F.lit(1).alias("random"))
    words = F.array(*map(F.lit, WORDS))
    several = ids.sparkSession.range(25 * n).withColumn("h", F.xxhash64(F.lit("identifier"), "id"))
    picked = F.transform(F.sequence(F.lit(0), 1 + F.pmod("h", F.lit(5)).cast("int")), lambda k: F.get(words, F.pmod(F.xxhash64("id", k), F.lit(len(WORDS))).cast("int")))
    return random.union(several.select(_identifiers(picked, F.col("h")).alias("token"), F.lit(0).alias("random")))


def corpus_samples(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, groups: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, random) from at most max_docs documents with an id.

    Base spans of 12 or more characters with a digit are random strings. Identifiers are `groups` words of a text, and names
    of as many groups of neighbouring words, evenly spaced through it, so they don't outnumber those made by rule.
    """
    order = F.xxhash64(id_col)
    last = hash_sample(docs.filter(F.col(id_col).isNotNull()).select(id_col), max_docs, id_col).agg(F.max(order)).first()[0]
    some = docs.filter(F.col(id_col).isNotNull() & (order <= F.lit(last if last is not None else -(1 << 63)))).select(F.xxhash64(id_col, F.lit(1)).alias("h"), F.col(text_col).alias("text"))
    rest = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, HEX), F.col("text"))
    values = F.concat(_matches(F.col("text"), ASSIGN, 2), _matches(F.col("text"), ACCESS), _matches(F.col("text"), HEX))
    random = some.select(F.explode(F.filter(values, lambda v: (F.length(v) >= 12) & v.rlike("[0-9]"))).alias("token"), F.lit(1).alias("random"))
    every = some.select(_matches(rest, SAMPLE_TOKEN).alias("w")).filter(F.size("w") > 0)
    words = every.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.get("w", (k * F.size("w") / groups).cast("int")))).alias("token"), F.lit(0).alias("random"))
    plain = some.select("h", _matches(F.lower("text"), r"[a-z]{3,12}").alias("w")).filter(F.size("w") >= 4 * groups)
    spaced = plain.select("h", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.slice("w", 1 + (k * F.size("w") / groups).cast("int"), 2 + F.pmod(F.col("h") + k, F.lit(3)).cast("int")))).alias("k", "w"))
    names = spaced.select(_identifiers(F.col("w"), F.xxhash64("h", "k")).alias("token"), F.lit(0).alias("random"))
    return random.union(words).union(names)


def fit_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios log P(b|a, random) - log P(b|a, identifier) for each pair of ALPHABET, from (token, random) rows.

    Add-one smoothing; without samples every ratio is 0. The counts are at most two for each pair of characters.
    """
    t = F.concat(F.lit("^"), F.col("token"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(t, i, F.lit(2)))
    counts = samples.filter(F.length("token") > 0).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    n, width = [[1.0] * len(ALPHABET) ** 2 for _ in range(2)], len(ALPHABET)
    for r in counts:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            n[r["random"]][a * width + b] += r["count"]
    total = [[sum(x[a * width : a * width + width]) for a in range(width)] for x in n]
    return [math.log(n[1][k] / total[1][k // width]) - math.log(n[0][k] / total[0][k // width]) for k in range(width * width)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios along a token; characters outside ALPHABET count as its first."""
    codes = F.transform(F.split(F.concat(F.lit("^"), token), ""), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c), F.lit(1)) - 1)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # a constant, folded once
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def _scanned(docs: DataFrame, ratios: list[float], text_col: str, min_ratio: float) -> DataFrame:
    """(_row, _text, and a column for each of KINDS): _row holds the row of docs."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(text_col).cast("string").alias("_text"))
    rows = _base_spans(rows)
    blank = lambda start, end, to: F.repeat(F.lit(" "), F.greatest(F.lit(0), end - F.greatest(start, to)))
    masked = _replaced(F.col("_text"), F.concat("assign", "access", "hex"), blank)
    rows = rows.withColumn("_masked", F.coalesce(masked, "_text"))
    named = F.regexp_replace("_masked", UUID, " " * 36)
    rows = rows.withColumn("_masked", F.when(F.col("_token"), named).otherwise(F.col("_masked")))
    rows = _spans(rows, "markov", TOKEN, "_masked", F.col("_token"))
    return rows.withColumn("markov", F.filter("markov", lambda m: log_ratio(m["value"], ratios) >= min_ratio)).drop("_masked", "_token")


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs with the array columns assign, access, hex and markov of (start, end, kind, value, byte).

    Null texts have empty arrays, an empty table gives no rows, repeated rows are scanned alike. Columns of docs with one of
    these four names are replaced; all others stay. The models are asked about tokens outside the base spans: of a token that
    a base span cuts, each part of at least 16 characters. Texts are read whole, and the work grows with their length and the
    number of their spans.
    """
    kept = [c for c in docs.columns if c.lower() not in KINDS]
    rows = _scanned(docs, ratios, text_col, min_ratio)
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], *KINDS)


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds by start, then by the order of KINDS, comma-joined."""
    spans = F.concat(*[F.transform(k, lambda s, i=KINDS.index(k): F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The rows and columns of docs; the characters of every span, overlapping ones merged, give way to the mask.

    n_chars is counted again where a text changes. Null texts stay null, empty ones empty; an empty table gives no rows.
    Other columns stay as they are, whatever their names and types.
    """
    names = docs.columns
    rows = _scanned(docs, ratios, text_col, MIN_RATIO)
    masked = lambda start, end, to: F.when(start >= to, F.lit(mask)).otherwise("")
    rows = rows.withColumn("_clean", _replaced(F.col("_text"), F.concat(*KINDS), masked))
    out = {c: F.col("_row")[c] for c in names}
    if "n_chars" in out:
        n = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("_clean").isNotNull(), n).otherwise(out["n_chars"])
    out[text_col] = F.coalesce("_clean", "_text")
    return rows.select(*[out[c].alias(c) for c in names])
