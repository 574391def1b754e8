"""Operators on small tables with the awkward cases: hot groups, ties, nulls, edges."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from millrace.functions import hundredths, interval
from millrace.operators import (
    count_rows,
    except_all,
    except_distinct,
    intersect_all,
    intersect_distinct,
    running,
    sessions,
    sliding,
    subtotals,
    top_k,
    tumbling,
    union_distinct,
    with_match,
    without_match,
)
from millrace.sources import Tables

START = datetime(2024, 1, 1)


def rows(df) -> Counter:
    return Counter(df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Events of which a third belong to one user, and many of those to one instant."""
    events = Tables(spark, str(TESTDATA / "sf0.001")).events.drop("props")
    number = F.col("event_id")
    hot, nobody = number % 3 == 0, number % 50 == 1
    user = F.when(hot, F.lit(7)).when(nobody, None).otherwise(F.col("user_id"))
    ts = F.when(hot & (number > 400), F.lit(START)).otherwise(F.col("ts"))
    value = F.when(number % 7 == 0, None).otherwise(F.col("value"))
    return events.withColumns({"user_id": user, "ts": ts, "value": value})


@pytest.mark.parametrize("piece_rows", [10, 64, 999])
def test_running_in_pieces_gives_the_same_rows(spark, skewed, piece_rows):
    arguments = dict(
        keys=["user_id"],
        order=["ts", "event_id"],
        totals={"n": F.lit(1).cast("bigint"), "total": hundredths("value")},
        previous={"previous_ts": "ts", "previous_value": "value"},
    )
    plain = running(skewed, **arguments)
    pieces = running(skewed, **arguments, max_group_rows=100, piece_rows=piece_rows)
    assert pieces.schema.simpleString() == plain.schema.simpleString()
    assert "_piece" in pieces._jdf.queryExecution().toString()
    assert rows(pieces) == rows(plain)


def test_running_uses_one_window_while_groups_are_small(spark, skewed):
    plan = running(skewed, ["user_id"], ["ts", "event_id"], {"n": F.lit(1)})
    assert "_piece" not in plan._jdf.queryExecution().toString()


def test_running_over_an_empty_table(spark, skewed):
    assert running(skewed.filter("false"), ["user_id"], ["ts"], {"n": F.lit(1)}).count() == 0


def test_top_k_cuts_hot_groups_before_the_shuffle(spark, skewed):
    top = top_k(skewed, 3, ["user_id"], [F.desc("value"), F.asc("event_id")])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 3, Partial" in plan
    by_user = {}
    for row in skewed.collect():
        by_user.setdefault(row.user_id, []).append(row)
    expected = Counter()
    for group in by_user.values():
        group.sort(key=lambda r: (r.value is None, -(r.value or 0), r.event_id))
        expected.update((r.event_id, n + 1) for n, r in enumerate(group[:3]))
    assert Counter((r.event_id, r["rank"]) for r in top.collect()) == expected


def test_existence_keeps_null_keys_only_where_there_is_no_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "id int, v string")
    right = spark.createDataFrame([(1,), (1,), (None,), (3,)], "key int")
    matched = with_match(left, right, {"id": "key"})
    unmatched = without_match(left, right, {"id": "key"})
    assert sorted(r.v for r in matched.collect()) == ["a", "d"]
    assert sorted(r.v for r in unmatched.collect()) == ["b", "c"]


@pytest.mark.parametrize("salts", [2, 7])
def test_salted_existence_gives_the_same_rows(skewed, salts):
    some = skewed.filter("event_type = 'view' or user_id = 7").select(F.col("user_id").alias("key"))
    on = {"user_id": "key"}
    assert rows(with_match(skewed, some, on, salts)) == rows(with_match(skewed, some, on))
    assert rows(without_match(skewed, some, on, salts)) == rows(without_match(skewed, some, on))


def test_existence_on_two_keys(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    right = spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "c int, d int")
    assert [tuple(r) for r in with_match(left, right, {"a": "c", "b": "d"}).collect()] == [(1, 2)]


@pytest.fixture(scope="module")
def bags(spark):
    left = [(1, "x")] * 25 + [(2, None)] * 7 + [(None, None)] * 3 + [(4, "y")]
    right = [("x", 1)] * 11 + [(None, 2)] * 9 + [(None, None)] * 1 + [("z", 5)]
    return (
        spark.createDataFrame(left, "a int, b string"),
        spark.createDataFrame(right, "b string, a int"),
    )


@pytest.mark.parametrize("block", [1, 4, 100_000])
def test_multisets_keep_counts(bags, block):
    left, right = bags
    same_order = right.select("a", "b")
    assert rows(intersect_all(left, right, block)) == rows(left.intersectAll(same_order))
    assert rows(except_all(left, right, block)) == rows(left.exceptAll(same_order))
    assert intersect_all(left, right).columns == left.columns


def test_sets_drop_copies(bags):
    left, right = bags
    same_order = right.select("a", "b")
    assert rows(union_distinct(left, right)) == rows(left.union(same_order).distinct())
    assert rows(intersect_distinct(left, right)) == rows(left.intersect(same_order))
    assert rows(except_distinct(left, right)) == rows(left.subtract(same_order))


@pytest.mark.parametrize("sets", ["rollup", "cube", [["a", "b"], ["b"], []]])
def test_subtotals_match_direct_grouping(spark, sets):
    df = spark.createDataFrame(
        [(1, "x", 5), (1, "x", 6), (1, None, 7), (2, "x", None), (None, "x", 8)],
        "a int, b string, v int",
    )
    direct = {
        "rollup": lambda: df.rollup("a", "b"),
        "cube": lambda: df.cube("a", "b"),
    }.get(
        sets if isinstance(sets, str) else "",
        lambda: df.groupingSets([[F.col(c) for c in one] for one in sets], "a", "b"),
    )()
    expected = direct.agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("total"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )
    value = F.col("v")
    measures = {
        "n": count_rows(),
        "total": ("sum", value),
        "low": ("min", value),
        "high": ("max", value),
    }
    actual = subtotals(df, ["a", "b"], measures, sets)
    assert actual.columns == expected.columns
    assert rows(actual) == rows(expected)


def measures():
    return {
        "n": count_rows(),
        "total": ("sum", hundredths("value")),
        "high": ("max", F.col("value")),
    }


def direct(df, window, *keys):
    grouped = df.groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hundredths("value")).alias("total"),
        F.max("value").alias("high"),
    )
    return grouped.select("w.start", "w.end", *keys, "n", "total", "high")


@pytest.mark.parametrize("minutes", [(60, 15), (60, 25), (10, 10), (90, 60)])
def test_sliding_panes_match_direct_windows(skewed, minutes):
    size, slide = (timedelta(minutes=m) for m in minutes)
    actual = sliding(skewed, "ts", size, slide, ["event_type"], measures())
    expected = direct(skewed, F.window("ts", interval(size), interval(slide)), "event_type")
    assert rows(actual.withColumnsRenamed({"window_start": "start", "window_end": "end"})) == rows(
        expected
    )


def test_tumbling_matches_direct_windows_before_1970(spark, skewed):
    early = skewed.withColumn("ts", F.col("ts") - F.expr("interval '20000' day"))
    size = timedelta(minutes=7)
    actual = tumbling(early, "ts", size, [], measures())
    expected = direct(early, F.window("ts", interval(size)))
    assert rows(actual.withColumnsRenamed({"window_start": "start", "window_end": "end"})) == rows(
        expected
    )


@pytest.mark.parametrize("days_back", [0, 20000])
@pytest.mark.parametrize("gap", [timedelta(seconds=1), timedelta(minutes=30), timedelta(hours=5)])
def test_sessions_match_session_window(skewed, gap, days_back):
    moved = skewed.withColumn("ts", F.col("ts") - F.expr(f"interval '{days_back}' day"))
    known = moved.filter("user_id is not null")
    actual = sessions(known, "ts", gap, ["user_id"], measures())
    expected = direct(known, F.session_window("ts", interval(gap)), "user_id")
    renamed = actual.withColumnsRenamed({"session_start": "start", "session_end": "end"})
    assert rows(renamed) == rows(expected)


def test_session_goes_on_at_exactly_the_gap(spark):
    gap = timedelta(minutes=30)
    seconds = [0, 1799, 1800, 3600, 5401, 7201, 9001, 10802]
    df = spark.createDataFrame(
        [(1, START + timedelta(seconds=s), 1.0) for s in seconds],
        "user_id int, ts timestamp_ntz, value double",
    )
    found = sessions(df, "ts", gap, ["user_id"], measures()).orderBy("session_start").collect()
    assert [r.n for r in found] == [4, 3, 1]
    assert found[0].session_end == START + timedelta(seconds=3600) + gap
    direct_counts = direct(df, F.session_window("ts", interval(gap)), "user_id").orderBy("start")
    assert [r.n for r in direct_counts.collect()] == [4, 3, 1]
