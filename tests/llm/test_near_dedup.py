"""Near duplicates with repeated and missing ids, hot groups and hubs, against all pairs."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import groups
from pyspark.sql import functions as F

from millrace.llm import components, keyed, near_dedup

SCHEMA = "doc_id bigint, text string"


def edited(rng, words, n, mark):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"{mark}_{i}"
    return " ".join(words)


def texts(rng, n):
    base = [f"w{i}" for i in range(90)]
    return [edited(rng, base, int(k), f"x{j}") for j, k in enumerate(rng.integers(0, 12, n))]


def test_an_id_that_is_repeated_often_is_one_document(spark, shared):
    rng = np.random.default_rng(2)
    many = texts(rng, 40)
    rows = [(1, many[0])] * 1000 + [(2, t) for t in many[1:20]] * 15 + [(i, t) for i, t in enumerate(many[20:], 10)]
    rows += [(2, None), (5, ""), (5, "a text of its own that nobody else has")]
    distinct = sorted(set(rows), key=str)
    joined, places = [], defaultdict(list)
    for at, (key, _) in enumerate(distinct):
        joined += [(places[key][0], at)] if places[key] else []
        places[key].append(at)
    roots, sets = groups([t for _, t in distinct], 2, joined=joined)
    least = defaultdict(lambda: 1 << 60)
    for root, (key, _) in zip(roots, distinct):
        least[root] = min(least[root], key)
    expected = {row: (len(s), least[root], row[0] == least[root]) for row, s, root in zip(distinct, sets, roots)}
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 2, 80)
    counts = Counter((key, *expected[key, text]) for key, text in rows)
    assert Counter(map(tuple, found.collect())) == counts


@pytest.mark.parametrize("listed", [64, 1])
def test_one_row_of_each_group_stays(spark, shared, listed):
    rng = np.random.default_rng(3)
    some = texts(rng, 60) + ["", None, " ", "short text", "Short  TEXT"]
    ids = [None if k % 3 == 0 else int(k) // 2 for k in rng.integers(0, 60, len(some))]
    rows = [*zip(ids, some)] + [(7, some[0]), (7, "another text under an id in use"), (None, some[1])]
    docs = spark.createDataFrame([(k, t, f"s{n}") for n, (k, t) in enumerate(rows)], SCHEMA + ", row_name string")
    kept = near_dedup.representatives(docs.repartition(3), 2, 80, listed=listed, block=16).collect()
    roots, sets = groups([t for _, t in rows], 2)
    least = defaultdict(lambda: (True, 0))
    for root, (key, _), own in zip(roots, rows, sets):
        if own:
            least[root] = min(least[root], (key is None, key or 0))
    at = [int(r.row_name[1:]) for r in kept]
    assert sorted(i for i in at if not sets[i]) == [i for i, own in enumerate(sets) if not own]
    worded = [i for i in at if sets[i]]
    assert sorted(roots[i] for i in worded) == sorted(least)
    assert all((rows[i][0] is None, rows[i][0] or 0) == least[roots[i]] for i in worded)
    assert [tuple(r) for r in kept] == [(rows[i][0], rows[i][1], f"s{i}") for i in at]


def test_representatives_of_awkward_and_empty_tables(awkward, nothing):
    kept = near_dedup.representatives(awkward).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 3, 4, 5, 6, 7])
    assert near_dedup.representatives(nothing).count() == 0


def test_a_hub_of_many_links_is_split(spark, shared, monkeypatch):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(1, 60_000).select(F.lit(0).cast("bigint").alias("lo"), F.col("id").alias("hi"))
        links = links.repartition(16)
        moved = components._large_star(links)
        moved.collect()
        assert "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    roots = components.components(links.unionByName(spark.createDataFrame([(70_000, 70_001)], "lo bigint, hi bigint")), "lo", "hi")
    counts = {r.root: r["count"] for r in roots.groupBy("root").count().collect()}
    assert counts == {0: 60_000, 70_000: 2}


def shuffled_rows(df, column):
    """Rows that the executed plan of ``df`` wrote into shuffles that carry ``column``."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        elif name == "Exchange" and f"{column}#" in node.output().toString():
            found += node.metrics().get("shuffleRecordsWritten").get().value()
        left += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("copies", [1, 30])
def test_most_texts_are_not_shuffled(spark, shared, copies):
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(20))) for k in range(400)]
    rows += [(1000 * c + k, rows[k][1]) for c in range(1, copies + 1) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dedup.representatives(docs)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
        # The fewer of kept and dropped rows, and what the filter can't tell from them.
        assert shuffled_rows(kept, "text") < 1.1 * min(400, 40 * copies) + 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256, 1])
def test_rows_are_looked_up_exactly(spark, shared, filter_bytes):
    rows = [(None if k % 7 == 0 else k * 5 - 900, f"r{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "key bigint, name string").repartition(3)
    keys = [None, -900, *range(-895, 800, 15), 7]
    table = spark.createDataFrame([(k,) for k in keys], "key bigint")
    wanted = {k for k in keys if k is not None}
    left = keyed.without_keys(df, table, "key", filter_bytes).select("key", "name").collect()
    assert Counter(map(tuple, left)) == Counter(r for r in rows if r[0] not in wanted)
    some = {tuple(r) for r in keyed.with_keys(df, table, "key", filter_bytes).collect()}
    assert {r for r in rows if r[0] in wanted} <= some
    assert len(some) < 200 or filter_bytes < 1000
    assert keyed.with_keys(df, table.limit(0), "key").count() == 0
    assert keyed.without_keys(df, table.limit(0), "key").count() == 1000
