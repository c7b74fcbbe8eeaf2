"""Every registered query of the base operators beside its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tarnloom.plans import workflows as W
from tarnloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = duck.sql(SQL[name])
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got[1]


def test_clean_records_bounds_the_text_as_given(spark, tmp_path):
    odd = ["-" * 3 + "a" * 98, "b" * 99 + "ß", "b" * 98 + "ß", "c" * 4995 + "ß" * 5, "d" * 4998 + "---", "d" * 4997 + "---", "e" * 99, "e" * 5001, "-" * 100, "G" * 100, "g" * 100 + "-", "-" * 4999 + "G" * 100]
    texts = [*odd, None, "", *[f"{k:03d}" * 40 for k in range(30)]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{path}")
    got = sorted(tuple(r) for r in QUERIES["e1_clean_records"](spark, f"file://{tmp_path}").collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    assert got == sorted(c.sql(SQL["e1_clean_records"]).fetchall())
    assert got[:6] == [(0, 98), (1, 101), (3, 5005), (5, 4997), (8, 0), (9, 100)] and got[6:] == [(k, 120) for k in range(14, 44)]
    rows = spark.createDataFrame([(f"r{k}", t, k) for k, t in enumerate(texts)], "id string, body string, ordinal long")
    cleaned = {r["ordinal"] for r in W.clean_records(rows, 100, 5000).collect()}  # by itself the operator bounds cleaned bodies
    assert cleaned == {1, 2, 4, 5, 9, *range(14, 44)}


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_points_without_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/tarnloom", tmp_path / "tarnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(__spark_entry__.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
