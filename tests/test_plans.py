"""What the plans look like: nothing that grows badly with the tables."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from compare import TESTDATA, assert_same, duckdb_tables
from pyspark.sql import functions as F

from millrace.operators import with_match
from millrace.plans import QUERIES, SQL
from millrace.plans.joins import in_year
from millrace.sources import Tables

ROOT = str(TESTDATA / "sf0.01")
BATCH = [name for name in QUERIES if not name.endswith("_stream")]


@contextmanager
def settings(spark, **values):
    named = {"spark.sql." + key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    for key, value in named.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return execution.explainString(mode)


@pytest.mark.parametrize("name", BATCH)
def test_no_query_pairs_all_rows_or_runs_python_or_hints_a_broadcast(spark, name):
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        plan = executed(QUERIES[name](spark, ROOT))
    for bad in ("CartesianProduct", "NestedLoop", "Python", "SinglePartition", "BroadcastExchange"):
        assert bad not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = formatted(QUERIES["nation_revenue"](spark, ROOT))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,1998-01-01T00:00)" in plan


@pytest.mark.parametrize(
    "name, shuffles",
    [
        # lines, orders, customers, nations; sums per customer and per nation
        ("nation_revenue", 6),
        # keys of one side, and the other side
        ("orders_without_lines", 2),
        ("top_orders_per_customer", 1),
        ("hourly_events", 1),
        ("hourly_events_every_quarter", 2),
        # events per slot, slots per user
        ("user_sessions", 2),
        ("event_gaps", 1),
        ("props_by_type", 1),
    ],
)
def test_number_of_shuffles(spark, name, shuffles):
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false"):
        plan = executed(QUERIES[name](spark, ROOT))
    assert plan.count("Exchange hashpartitioning") == shuffles


def test_repeated_keys_are_removed_before_the_semi_join_shuffles(spark):
    tables = Tables(spark, ROOT)
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false"):
        plan = executed(with_match(tables.orders, tables.lineitem, {"o_orderkey": "l_orderkey"}))
    build = plan[plan.index("LeftSemi") :]
    assert build.count("HashAggregate(keys=[l_orderkey") == 2
    assert build.count("Exchange hashpartitioning(l_orderkey") == 1


def test_hot_join_key_is_split_at_run_time(spark, tmp_path):
    """Half of all lines on one order: adaptive execution splits that partition."""
    tables = Tables(spark, ROOT)
    in_1997 = tables.orders.filter(in_year("o_orderdate", 1997)).agg(F.min("o_orderkey"))
    hot = F.when(F.col("l_linenumber") > 3, F.lit(in_1997.first()[0]))
    lines = tables.lineitem.withColumn("l_orderkey", hot.otherwise(F.col("l_orderkey")))
    lines.repartition(16).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("orders", "customer", "supplier", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{ROOT}/{name}.parquet")
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="64k",
        adaptive__coalescePartitions__enabled="false",
    ):
        revenue = QUERIES["local_supplier_revenue"](spark, str(tmp_path))
        found = revenue.toArrow()
        assert "SortMergeJoin(skew=true)" in executed(revenue)
    expected = duckdb_tables(ROOT)
    expected.execute(
        f"create or replace view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'"
    )
    assert_same(found, expected.sql(SQL["local_supplier_revenue"]).to_arrow_table())
