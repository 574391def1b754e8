from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import (
    amount,
    from_instant,
    hundredths,
    micros,
    net_price,
    span_micros,
    to_instant,
    with_json_longs,
)

TIMES = [
    datetime(1969, 12, 31, 23, 59, 59, 999999),
    datetime(1970, 1, 1),
    datetime(2024, 1, 1, 0, 0, 7, 179575),
    datetime(2024, 3, 10, 2, 30),  # skipped by the clocks of New York
    datetime(2024, 11, 3, 1, 30, 0, 1),  # passed twice by them
    datetime(2300, 2, 28, 12, 0, 0, 5),
]


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_event_time_does_not_depend_on_the_session_zone(spark, zone):
    df = spark.createDataFrame([(t,) for t in TIMES], "ts timestamp_ntz")
    rows = df.select(
        "ts",
        micros("ts").alias("micros"),
        F.unix_micros(to_instant("ts")).alias("instant"),
        from_instant(to_instant("ts")).alias("back"),
    ).collect()
    for row in rows:
        expected = (row.ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        assert row.micros == row.instant == expected
        assert row.back == row.ts


def test_span_micros_of_negative_and_missing_spans(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), datetime(2024, 1, 3, 1, 2, 3, 4)), (datetime(2024, 1, 1), None)],
        "a timestamp_ntz, b timestamp_ntz",
    )
    rows = df.select(
        span_micros(F.col("b") - F.col("a")).alias("ahead"),
        span_micros(F.col("a") - F.col("b")).alias("back"),
    ).collect()
    span = timedelta(days=2, hours=1, minutes=2, seconds=3, microseconds=4)
    assert rows[0].ahead == span // timedelta(microseconds=1) == -rows[0].back
    assert rows[1].ahead is None and rows[1].back is None


def test_money_is_exact(spark):
    df = spark.createDataFrame(
        [(0.1, 0.0), (0.2, 0.07), (104999.91, 0.1), (-3.35, 0.29), (1.15, 0.57)],
        "p double, d double",
    )
    row = df.agg(
        F.sum(hundredths("p")).alias("cents"), F.sum(net_price("p", "d")).alias("net")
    ).first()
    assert row.cents == 10 + 20 + 10499991 - 335 + 115
    assert row.net == 10 * 100 + 20 * 93 + 10499991 * 90 - 335 * 71 + 115 * 43
    assert df.agg(F.sum(hundredths("p")).alias("p")).select(amount("p")).first().p == 104998.01


def test_every_cent_is_recovered_from_its_double(spark):
    # All cents of a range of amounts, small and large, against Spark's decimal cast.
    cents = spark.range(0, 2_000_000).selectExpr("id", "id + 999999000000 as far")
    amounts = cents.selectExpr("id", "id / 100D as near", "far", "far / 100D as big")
    wrong = amounts.filter(
        (hundredths("near") != F.col("id")) | (hundredths("big") != F.col("far"))
    )
    assert wrong.count() == 0


def test_json_longs(spark):
    values = {
        '{"k": 5}': 5,
        '{"k": "7"}': 7,
        '{"k": -0}': 0,
        '{"k": 9223372036854775807}': 2**63 - 1,
        '{"k": 9223372036854775808}': None,
        '{"k": 1.5}': None,
        '{"k": 1.0}': None,
        '{"k": 1e2}': None,
        '{"k": " 5"}': None,
        '{"k": "x"}': None,
        '{"k": [5]}': None,
        '{"k": true}': None,
        '{"k": null}': None,
        '{"j": 1}': None,
        '{"j": {"k": 1}}': None,
        '{"k": 5': None,
        '[{"k": 5}]': None,
        "not json": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in values], "props string")
    rows = with_json_longs(df, "props", {"k": "k"}).collect()
    assert {row.props: row.k for row in rows} == values


def test_json_longs_of_several_fields(spark):
    texts = ['{"a.b": 1, "c": 2, "a": {"b": 3}}', '{"c": 4}', None]
    df = spark.createDataFrame([(t, n) for n, t in enumerate(texts)], "props string, n int")
    found = with_json_longs(df, "props", {"x": "a.b", "y": "c"})
    assert found.columns == ["props", "n", "x", "y"]
    assert sorted(row[1:] for row in found.collect()) == [(0, 1, 2), (1, None, 4), (2, None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("json_tuple") == 1
