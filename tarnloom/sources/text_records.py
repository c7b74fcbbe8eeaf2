"""Line-based inputs: text records, path and item lists, metric lines, fixed-width atoms, trees and file listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WHITELIST, clean_text, parse_metric, ungapped
from ..operators.joins import beginnings
from ..operators.ranking import first_occurrences
from ..operators.sampling import seeded


def with_ordinal(df: DataFrame) -> DataFrame:
    """Add source_file and ordinal (place of the split in its file, then of the line in its split): input order within a file."""
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "ordinal": F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))})


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, body, source_file, ordinal) of `>id description` records with bodies over several lines."""
    raw = with_ordinal(spark.read.option("lineSep", "\n>").text(path))
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "")
    body = F.when(F.instr(record, "\n") > 0, F.regexp_replace(F.substring(record, F.instr(record, "\n") + 1, F.length(record)), r"[\r\n ]", "")).otherwise("")
    rows = raw.select(head.alias("description"), body.alias("body"), "source_file", "ordinal").filter((F.trim("description") != "") | (F.length("body") > 0))
    return rows.select(F.split_part(F.trim("description"), F.lit(" "), F.lit(1)).alias("id"), "description", "body", "source_file", "ordinal")


def ungapped_records(records: DataFrame) -> DataFrame:
    """Upper-case bodies without gaps; empty ones are dropped."""
    return records.withColumn("body", ungapped("body")).filter(F.length("body") > 0)


def whitelisted_records(records: DataFrame, whitelist: str = WHITELIST) -> DataFrame:
    """Bodies of whitelisted characters only; empty ones are dropped; nameless ones are named after their ordinal."""
    named = F.when(F.length("id") > 0, F.col("id")).otherwise(F.concat(F.lit("scenario_"), F.col("ordinal.line").cast("string")))
    return records.withColumns({"body": clean_text("body", whitelist), "id": named}).filter(F.length("body") > 0)


def sampled_records(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement, in input order."""
    return records.orderBy(seeded(seed, "id"), "id").limit(n).orderBy("source_file", "ordinal")


def record_map(records: DataFrame) -> DataFrame:
    """One row for each id: the last one."""
    order = F.struct("source_file", "ordinal")
    return records.groupBy("id").agg(F.max_by(F.struct("description", "body"), order).alias("r")).select("id", "r.description", "r.body")


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, n): lines that begin a record."""
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return lines.filter(F.col("value").startswith(">")).groupBy("source_file").agg(F.count("*").alias("n"))


def scan_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal): listed paths without blanks and # comments, relative ones under the list's folder, first occurrences only."""
    rows = with_ordinal(spark.read.text(path)).withColumn("value", F.trim("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    full = F.when(F.col("value").rlike(r"^(/|[a-z0-9]+:)"), F.col("value")).otherwise(F.concat_ws("/", folder, "value"))
    return first_occurrences(rows.select(full.alias("path"), F.struct("source_file", "ordinal").alias("ordinal")), ["path"], "ordinal")


def scan_items(spark: SparkSession, path: str) -> DataFrame:
    """(item, ordinal): one cleaned item a line; blanks are dropped."""
    rows = with_ordinal(spark.read.text(path))
    return rows.select(clean_text("value").alias("item"), F.struct("source_file", "ordinal").alias("ordinal")).filter(F.length("item") > 0)


def line_numbers(lines: DataFrame, some: DataFrame) -> DataFrame:
    """some, a few rows of lines (source_file, ordinal), with `number`: the line's place in its file, from 1.

    Lines are counted by splits; a split's first line follows those of all splits before it, so a row a split is put in order.
    """
    splits = lines.groupBy("source_file", F.col("ordinal.at").alias("_at")).agg(F.count("*").alias("_n"), F.min("ordinal.line").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_at")) - F.col("_n")
    splits = splits.withColumn("_before", before).withColumnRenamed("source_file", "_file")
    out = some.join(splits, (F.col("source_file") == F.col("_file")) & (F.col("ordinal.at") == F.col("_at")))
    return out.withColumn("number", F.col("_before") + F.col("ordinal.line") - F.col("_first") + 1).drop("_file", "_at", "_n", "_first", "_before")


def failing_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, number, value) of the lines whose last word has no slash. Lines are counted only if there are any."""
    lines = with_ordinal(spark.read.text(path))
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    bad = lines.filter((F.trim("value") != "") & ~last.contains("/"))
    if bad.isEmpty():
        return bad.select("source_file", F.lit(None).cast("bigint").alias("number"), "value")
    return line_numbers(lines, bad).select("source_file", "number", "value")


def scan_metric_lines(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """(target, item, metrics, source_file, ordinal) of `k:v k:v … target/item` lines; the last slash divides.

    metrics maps keys to struct(i, d, s); of repeated keys the last counts. A line whose last word has no slash is a ValueError
    that names the file and the line, found by one more pass over the files; lines with an empty item are dropped. With
    checked=False there is no such pass, and a job that meets such a line fails without its number.
    """
    if checked:
        first = failing_metric_lines(spark, path).orderBy("source_file", "number").limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['source_file']}:{first[0]['number']}: expected target/item at the end of: {first[0]['value']}")
    rows = with_ordinal(spark.read.text(path)).withColumn("value", F.trim("value")).filter("value <> ''").withColumn("words", F.split("value", r"\s+"))
    pair = F.element_at("words", -1)
    pair = F.when(pair.contains("/"), pair).otherwise(F.raise_error(F.concat(F.col("source_file"), F.lit(": expected target/item at the end of: "), F.col("value"))))
    parsed = F.transform(F.slice("words", F.lit(1), F.size("words") - 1), parse_metric)
    metrics = F.aggregate(
        F.filter(parsed, lambda m: m.isNotNull()),
        F.expr("cast(map() as map<string, struct<i:bigint,d:double,s:string>>)"),
        lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: k != m["key"]), F.map_from_arrays(F.array(m["key"]), F.array(F.struct(m["i"].alias("i"), m["d"].alias("d"), m["s"].alias("s"))))),
    )
    out = rows.withColumn("pair", pair).select(clean_text(F.regexp_extract("pair", "^(.*)/([^/]*)$", 1)).alias("target"), clean_text(F.regexp_extract("pair", "^(.*)/([^/]*)$", 2)).alias("item"), metrics.alias("metrics"), "source_file", "ordinal")
    return out.filter(F.length("item") > 0)


#: One-letter codes of residue names.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def scan_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, chain, residue, number, insertion, atom, x, y, z, ordinal) of fixed-width ATOM lines."""
    rows = with_ordinal(spark.read.text(path)).filter(F.col("value").startswith("ATOM"))
    cut = lambda a, b: F.trim(F.substring("value", a + 1, b - a))
    return rows.select("source_file", F.substring("value", 22, 1).alias("chain"), cut(17, 20).alias("residue"), cut(22, 26).cast("int").alias("number"), F.substring("value", 27, 1).alias("insertion"), cut(12, 16).alias("atom"), *[cut(a, a + 8).cast("double").alias(n) for n, a in (("x", 30), ("y", 38), ("z", 46))], "ordinal")


def chain_letters(atoms: DataFrame, letters: dict[str, str] = RESIDUES) -> DataFrame:
    """(source_file, chain, body): one letter for each distinct residue in file order, X for unknown names."""
    lookup = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    first = first_occurrences(atoms.select("source_file", "chain", "number", "insertion", "residue", "ordinal"), ["source_file", "chain", "number", "insertion"], "ordinal")
    letter = F.coalesce(F.try_element_at(lookup, F.col("residue")), F.lit("X"))
    return first.groupBy("source_file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", letter.alias("l")))), lambda r: r["l"]), "").alias("body"))


def list_files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, name, stem, length) of the files that match; order by path for a sorted listing. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def paired_files(names: DataFrame, files: DataFrame, suffix: str = "_aligned.fasta") -> DataFrame:
    """names (name) with `path`: the file called name + suffix, else the only file that begins with name, else null."""
    exact = files.filter(F.col("name").endswith(suffix)).select(F.expr(f"left(name, length(name) - {len(suffix)})").alias("_n"), F.col("path").alias("_exact"))
    begun = beginnings(files, "name", names, "name", "_b").groupBy("_b").agg(F.count("*").alias("_c"), F.max("path").alias("_only")).filter("_c = 1")
    joined = names.join(exact, names["name"] == F.col("_n"), "left").join(begun, names["name"] == F.col("_b"), "left")
    return joined.select(*[names[c] for c in names.columns], F.coalesce("_exact", "_only").alias("path"))


def parse_newick(text: str) -> list[tuple[str, str | None, str, float | None]]:
    """(node, parent, name, length) of one tree; nodes are numbered n0, n1, … in the order they open."""
    rows: list[list] = []
    path: list[int] = []

    def opened() -> int:
        rows.append([f"n{len(rows)}", f"n{path[-1]}" if path else None, "", None])
        return len(rows) - 1

    at, here = 0, opened()
    while at < len(text) and text[at] != ";":
        c = text[at]
        if c == "(":
            path.append(here)
            here = opened()
        elif c == ",":
            here = opened()
        elif c == ")":
            here = path.pop()
        elif c == "[":
            at = text.index("]", at)
        elif c == ":":
            end = at + 1
            while end < len(text) and text[end] not in ",();[":
                end += 1
            rows[here][3] = float(text[at + 1 : end])
            at = end - 1
        elif c == "'":
            end = text.index("'", at + 1)
            rows[here][2] = text[at + 1 : end]
            at = end
        elif not c.isspace():
            end = at
            while end < len(text) and text[end] not in ":,();[":
                end += 1
            rows[here][2] = text[at:end].strip()
            at = end - 1
        at += 1
    if path:
        raise ValueError("unbalanced tree")
    return [tuple(r) for r in rows]


def scan_trees(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".nwk", ".newick", ".tree", ".tre"), whole: int = 32 << 20) -> DataFrame:
    """(tree_id, node, parent, name, length): the edges of every tree file below the path, one row a node.

    Files of at most `whole` bytes are read by one task each, larger ones by all tasks that their splits go to.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(F.col("path").rlike(r"(%s)$" % "|".join(s.replace(".", r"\.") for s in suffixes)))
    large = [r["path"] for r in files.filter(F.col("length") > whole).select("path").collect()]  # few: each is large
    files = files.filter(F.col("length") <= whole).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                rows = parse_newick(bytes(r.content).decode())
                yield pd.DataFrame([(r.path, *x) for x in rows], columns=["tree_id", "node", "parent", "name", "length"])

    out = files.mapInPandas(run, "tree_id string, node string, parent string, name string, length double")
    if large:
        from .tree_ranges import scan_large_trees  # it reads pieces of text as this module does

        out = out.union(scan_large_trees(spark, large))
    return out


def keyed_lookup(registry: dict[str, dict], defaults: dict, name: str) -> dict:
    """The entry of a registry over the defaults; KeyError naming the valid entries."""
    if name not in registry:
        raise KeyError(f"unknown name {name!r}; valid: {', '.join(sorted(registry))}")
    return {**defaults, **registry[name]}


def score_files(files: DataFrame) -> DataFrame:
    """(key, path) from a listing (name, path): of each key (the stem before `_scores`) the file with `scores_rank_001`, else the first with `scores`."""
    files = files.filter(F.col("name").contains("_scores"))
    key: Column = F.regexp_extract("name", r"^(.*?)_scores", 1)
    return files.groupBy(key.alias("key")).agg(F.min(F.struct((~F.col("name").contains("scores_rank_001")).alias("o"), "path")).alias("r")).select("key", "r.path")


def scan_scores(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """(key, iptm, ptm, plddt_mean) of the score files below the path; the key is a file's name up to `_scores`.

    If any file is a `scores_rank_001`, only such files count. What is no JSON object is skipped; of several files of a key
    the last path counts. name gives a file's name from its path, by default what follows the last slash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("_name", name if name is not None else F.substring_index("path", "/", -1)).filter(F.col("_name").contains("scores"))
    if not files.filter(F.col("_name").contains("scores_rank_001")).select("path").isEmpty():
        files = files.filter(F.col("_name").contains("scores_rank_001"))
    shape = "iptm double, ptm double, plddt array<double>, broken string"
    read = F.from_json(F.decode("content", "utf-8"), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = files.select(F.split_part("_name", F.lit("_scores"), F.lit(1)).alias("key"), "path", read.alias("r")).filter("r is not null and r.broken is null")
    last = rows.groupBy("key").agg(F.max_by("r", "path").alias("r"))
    mean = F.when(F.size("r.plddt") > 0, F.aggregate("r.plddt", F.lit(0.0), lambda a, x: a + x) / F.size("r.plddt"))
    return last.select("key", F.col("r.iptm").alias("iptm"), F.col("r.ptm").alias("ptm"), mean.alias("plddt_mean"))
