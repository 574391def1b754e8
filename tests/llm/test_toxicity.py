"""The toxicity classifier against plain n-grams, ratios and a plain regression."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import tables, toxicity
from millrace.llm.queries import op6_toxicity

TEXTS = ["You IDIOT", "", None, "ça va", "Straße der Идиоты", "a", "long " * 300]


def grams(text):
    text = f" {(text or '').lower()} "
    return {text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1)}


def test_features_are_the_n_grams_of_code_points(monkeypatch):
    column = pa.array(TEXTS)
    row, bucket = toxicity.found_in(column)
    assert [*Counter(row.tolist()).items()] == [(i, len(grams(t))) for i, t in enumerate(TEXTS) if grams(t)]
    # Equal n-grams have equal buckets wherever they stand.
    names = sorted(set().union(*map(grams, TEXTS)))
    alone = {}
    for name in names:
        points = np.array([ord(c) for c in name], np.uint64)
        rows = np.zeros((2, len(points)), np.int64)
        found = toxicity.features(points, rows)[1]
        alone[name] = set(found.tolist())
    for i, text in enumerate(TEXTS):
        assert set().union(*(alone[g] for g in grams(text)), set()) == set(bucket[row == i].tolist())
    # A long text in parts gives the same.
    monkeypatch.setattr(toxicity, "_PIECE", 10)
    parts = toxicity.found_in(column)
    assert all((a == b).all() for a, b in zip(parts, (row, bucket)))


def test_ratios_shrink_by_three_errors():
    seen = np.array([[0, 100, 3, 50, 0], [40, 100, 0, 2, 1]])
    ratio = toxicity.log_count_ratios(seen)
    for k in range(5):
        a, b = seen[1, k] + 0.5, seen[0, k] + 0.5
        plain = np.log(a / (seen[1] + 0.5).sum()) - np.log(b / (seen[0] + 0.5).sum())
        least = 3 * np.sqrt(1 / a + 1 / b)
        expected = 0 if abs(plain) <= least else np.sign(plain) * (abs(plain) - least)
        assert np.isclose(ratio[k], expected)
    assert ratio[0] > 0 > ratio[3] and ratio[2] == ratio[4] == 0


def test_regression_is_at_its_minimum():
    rng = np.random.default_rng(4)
    ratios = np.zeros(1 << toxicity.BUCKET_BITS)
    ratios[:30] = rng.normal(size=30)
    found = [sorted(rng.choice(30, rng.integers(0, 8), replace=False)) for _ in range(200)]
    label = np.array([int(sum(ratios[f]) + rng.normal() > 0.5) for f in found])
    rows = pa.table({"label": pa.array(label, pa.int32()), "found": pa.array(found, pa.list_(pa.int32()))})
    model = toxicity._regression(rows, ratios, 200, 0.01)
    x = np.zeros((200, 30))
    for i, f in enumerate(found):
        x[i, f] = ratios[f]
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / 200

    def loss(w, bias):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        return -(weight * np.log(np.where(label == 1, p, 1 - p))).sum() + 0.005 * w @ w

    w, bias = model.weights[:30] / ratios[:30], model.bias
    least = loss(w, bias)
    for _ in range(200):
        assert loss(w + rng.normal(size=30) * 0.05, bias + rng.normal() * 0.05) > least - 1e-6


def test_held_out_rows_by_language(spark):
    root = "/root/testdata/sf0.1"
    found = op6_toxicity(spark, root).filter("held_out")
    labels, docs = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("labels", "documents"))
    rows = found.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right, alarms, of = Counter(), Counter(), Counter()
    for r in rows:
        of[r.lang, r.toxic] += 1
        right[r.lang] += r.toxic and r.predicted
        alarms[r.lang] += (not r.toxic) and r.predicted
    for lang in ("en", "de", "fr", "es"):
        assert right[lang] >= 0.85 * of[lang, 1] and alarms[lang] <= 0.05 * of[lang, 0], lang


def test_a_sample_is_bounded_whatever_repeats(spark, shared):
    rows = spark.range(9000).select(F.lit("x").alias("per"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("key"))
    text = F.when(F.col("key") == 7, F.lit("same")).otherwise(F.col("key").cast("string"))
    drawn = tables.even_sample(rows.withColumn("text", text), "per", ["key", "text"], 500)
    assert 300 < drawn.count() < 700
    hot = rows.withColumn("text", F.monotonically_increasing_id().cast("string"))
    assert 300 < tables.even_sample(hot, "per", ["key", "text"], 500).count() < 700
