"""Top-k search with repeated ids, and with values beyond what scores hold."""

from __future__ import annotations

import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.llm import impact_search, queries


def test_repeated_ids_equal_sql(spark, shared, tmp_path):
    rng = np.random.default_rng(6)
    ids = [100, 100, 200, 300, 100] + [7] * 150 + [*range(1, 200)]
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in ids]
    rows += [(100, rows[0][1]), (None, rows[1][1]), (400, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = connection.sql(queries.SQL["op4_impact_topk"]).fetchall()
    columns = [d[0] for d in connection.sql(queries.SQL["op4_impact_topk"]).description]
    found = queries.op4_impact_topk(spark, str(tmp_path)).select(*columns).collect()
    assert Counter(map(tuple, found)) == Counter(expected)
    assert len(found) == 10 * sum(i is not None and i % 100 == 0 for i, v in rows if v)


def test_a_repeated_id_fills_no_block(spark, shared):
    same = spark.range(3000).select(F.lit(5).cast("bigint").alias("vec_id"), F.array(F.col("id")).alias("vector"))
    sizes = [r.rows for r in impact_search.build(same, block_rows=300).select("rows").collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("value", [1e30, -1e16])
def test_huge_components_are_refused(spark, value):
    rows = spark.createDataFrame([(1, [value])], "vec_id bigint, embedding array<double>")
    with pytest.raises(PySparkException, match="too large"):
        rows.select(impact_search.whole("embedding")).collect()


def test_scores_beyond_53_bits_are_refused(spark, shared):
    vectors = spark.createDataFrame([(1, [1 << 30, 5]), (2, [1 << 30, 3])], "vec_id bigint, vector array<bigint>")
    with pytest.raises(PySparkException, match="53 bits"):
        impact_search.search(impact_search.build(vectors), vectors, k=1).collect()


def plain(ids, vectors, k):
    """The k best (score, id) with other ids of every vector, by all products."""
    out = []
    for start in range(0, len(ids), 500):
        scores = vectors[start : start + 500].astype(float) @ vectors.T.astype(float)
        scores[ids[start : start + 500, None] == ids] = -np.inf
        bar = np.partition(scores, -k, axis=1)[:, -k, None]
        for one, at in zip(scores, scores >= bar, strict=True):
            best = np.lexsort((ids[at], -one[at]))[:k]
            out.append([(s, i) for s, i in zip(one[at][best], ids[at][best], strict=True) if s > -np.inf])
    return out


def table_of(spark, ids, vectors):
    rows = ((int(i), [int(x) for x in v]) for i, v in zip(ids, vectors, strict=True))
    return spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")


@pytest.mark.parametrize("kind", ["ties", "equal", "lengths", "large", "negative"])
@pytest.mark.parametrize("part_bytes", [1 << 26, 4000])
def test_all_products_are_met(spark, shared, monkeypatch, kind, part_bytes):
    monkeypatch.setattr(impact_search, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(8)
    ids, vectors = rng.integers(0, 500, 700), np.floor(rng.normal(size=(700, 6)) * 100).astype(np.int64)
    if kind == "ties":
        vectors = vectors[rng.integers(0, 20, 700)]
    elif kind == "equal":
        vectors[:] = vectors[0]
        vectors[1] = 0
    elif kind == "lengths":
        vectors = np.floor(vectors * np.exp(2 * rng.normal(size=(700, 1)))).astype(np.int64)
    elif kind == "large":  # no longer whole in single precision
        vectors = vectors * (1 << 16) + rng.integers(0, 9, vectors.shape)
    else:
        vectors = np.abs(vectors) * np.where(np.arange(700) % 2, 1, -1)[:, None]
    table = table_of(spark, ids, vectors)
    found = impact_search.search(impact_search.build(table, block_rows=20), table, k=10, chunk_rows=30)
    expected = Counter((int(q), r, int(i), int(s)) for q, best in zip(ids, plain(ids, vectors, 10), strict=True)
                       for r, (s, i) in enumerate(best, 1))
    assert Counter(map(tuple, found.collect())) == expected


def test_time_is_near_that_of_all_products(spark, shared, tmp_path):
    rng = np.random.default_rng(9)
    ids, vectors = np.arange(40_000), np.floor(rng.normal(size=(40_000, 64)) * 128).astype(np.int64)
    table_of(spark, ids, vectors).write.parquet(f"{tmp_path}/vectors")
    table = spark.read.parquet(f"{tmp_path}/vectors")
    began = time.time()
    for start in range(0, 4000, 500):
        vectors[start : start + 500].astype(float) @ vectors.T.astype(float)
    direct = time.time() - began
    index = impact_search.build(table)
    began = time.time()
    assert impact_search.search(index, table.filter("vec_id < 4000")).count() == 40_000
    assert time.time() - began < 10 + 5 * direct
