"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from relictum.functions import seq
from relictum.plans import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(name, spark, duck):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        assert got
        return
    rel = duck.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.endswith("_whole") or f"{n}_whole" in queries.QUERIES])
def test_texts_are_cleaned_once(name, spark):
    """No filter, projection or lambda cleans a text again: once for each time the table is read."""
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(upper(text") == plan.count("Relation [doc_id") > 0


def test_short_dust_names_its_read_once(spark):
    plan = spark.range(1).select(seq.dust_short(F.col("id").cast("string")).alias("dust"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == plan.count("upper(") == 1
