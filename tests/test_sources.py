from __future__ import annotations

import pytest
from compare import TESTDATA, assert_same, duckdb_tables
from pyspark.sql import functions as F

from millrace.plans import REPORTS, SQL
from millrace.sources import SCHEMAS, CatalogTables, SkewedKey, Tables, save_bucketed

ROOT = str(TESTDATA / "sf0.01")


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", SCHEMAS)
def test_declared_schema_is_the_schema_of_the_file(spark, name, scale):
    tables = Tables(spark, str(TESTDATA / scale))
    inferred = spark.read.parquet(tables.path(name)).schema
    assert getattr(tables, name).schema.simpleString() == inferred.simpleString()


def test_unknown_table(spark):
    with pytest.raises(AttributeError):
        Tables(spark, ROOT).nothing


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"create database kept location '{tmp_path}/kept'")
    files = Tables(spark, ROOT)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        save_bucketed(getattr(files, name), f"kept.{name}", key, 8, f"{tmp_path}/{name}")
    for name in ("customer", "nation", "region"):
        spark.sql(f"create table kept.{name} using parquet location '{files.path(name)}'")
    yield "kept"
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        spark.sql(f"drop table kept.{name}")
    spark.sql("drop database kept")


@pytest.mark.parametrize("name", ["nation_revenue", "revenue_rollup", "orders_without_lines"])
def test_bucketed_tables_meet_without_a_shuffle(spark, database, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = REPORTS[name](CatalogTables(spark, database))
        found = report.toArrow()
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for key in ("l_orderkey", "o_orderkey"):
        assert f"Exchange hashpartitioning({key}" not in plan
    assert_same(found, duckdb_tables(ROOT).sql(SQL[name]).to_arrow_table())


def test_hot_key_is_not_bucketed(spark, tmp_path):
    lines = Tables(spark, ROOT).lineitem
    hot = F.when(F.col("l_linenumber") < 3, F.lit(5)).otherwise(F.col("l_orderkey"))
    skewed = lines.withColumn("l_orderkey", hot)
    with pytest.raises(SkewedKey):
        save_bucketed(skewed, "hot", "l_orderkey", 8, str(tmp_path / "hot"))
    assert not spark.catalog.tableExists("hot")
