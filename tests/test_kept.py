"""Kept sums against a full run, over changes, restarts and lost drivers."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import KeptSums, signed_sums

SCHEMA = "k string, v bigint, sign int"


@pytest.fixture
def kept(spark, tmp_path):
    return KeptSums(spark, f"{tmp_path}/kept", ["k"], ["total"])


def change(spark, *rows):
    return signed_sums(spark.createDataFrame(rows, SCHEMA), ["k"], {"total": F.col("v")}, "sign")


def state(kept):
    return {r.k: (r.total, r.n_rows) for r in kept.current().collect()}


def test_changes_add_up_to_a_full_run(spark, kept):
    rows = [[(["hot", "a", None][min(2, i % 5)], i, 1) for i in range(n, 300, 7)] for n in range(7)]
    for n, part in enumerate(rows):
        assert kept.apply(f"part {n}", change(spark, *part))
    assert kept.apply("back", change(spark, *((k, v, -1) for k, v, _ in rows[3])))
    left = [r for n, part in enumerate(rows) if n != 3 for r in part]
    full = change(spark, *left).collect()
    assert state(kept) == {r.k: (r.total, r.n_rows) for r in full}


def test_a_change_is_applied_once_and_empty_groups_go(spark, kept):
    assert kept.apply("one", change(spark, ("a", 5, 1), ("b", None, 1), ("c", 1, 1)))
    assert not kept.apply("one", change(spark, ("a", 5, 1)))
    assert state(kept) == {"a": (5, 1), "b": (0, 1), "c": (1, 1)}
    assert kept.apply("two", change(spark, ("a", 5, -1), ("b", None, -1)))
    assert state(kept) == {"c": (1, 1)} and kept.applied() == {"one", "two"}
    assert kept.apply("nothing", change(spark, ("x", 1, 1)).limit(0)) and state(kept) == {"c": (1, 1)}


def test_rows_that_are_not_there_can_not_be_taken_back(spark, kept):
    with pytest.raises(LookupError):
        kept.current()
    kept.apply("one", change(spark, ("a", 5, 1)))
    for wrong in (("a", 4, -1), ("b", 1, -1), ("a", 1, None)):
        with pytest.raises(PySparkException):
            kept.apply("wrong", change(spark, wrong))
    assert state(kept) == {"a": (5, 1)}


def test_a_driver_lost_between_sums_and_names(spark, kept, tmp_path):
    kept.apply("one", change(spark, ("a", 5, 1)))
    change(spark, ("a", 99, 1)).write.parquet(f"{tmp_path}/kept/version=2/sums")
    again = KeptSums(spark, f"{tmp_path}/kept", ["k"], ["total"])
    assert state(again) == {"a": (5, 1)}
    assert again.apply("two", change(spark, ("a", 6, 1))) and state(again) == {"a": (11, 2)}
