"""The mix against a queue in plain Python, with and without its cut."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from plain import queue
from pyspark.sql import functions as F

from millrace.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def table(spark, kind):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        source = ["a", "b", "c", "d", None, "é", ""][min(6, int(rng.exponential(1.5)))]
        words = int(rng.pareto(1.2) * 20) % 900
        key = None if kind == "nulls" and k % 3 else k // 5 if kind == "repeats" else k
        rows.append((key, " ".join(f"w{k}" for _ in range(words)) or None, source))
    if kind == "repeats":
        rows += [(7, "the same words again", "b")] * 150
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("kind", ["plain", "nulls", "repeats"])
def test_mix_equals_a_plain_queue(spark, shared, kind):
    docs = table(spark, kind)
    turn = F.xxhash64(F.lit(10), "doc_id", "text")
    rows = docs.select("source", "doc_id", mixing.word_count("text"), turn).collect()
    taken, targets = queue([tuple(r) for r in rows])
    found = mixing.mixed(docs).collect()
    expected = Counter((r[0], r[1], r[2], t) for r, t in zip(rows, taken))
    assert Counter((r.source, r.doc_id, r.size, r.taken) for r in found) == expected
    assert all(abs(targets[r.source] - r.target) < 1e-6 for r in found)
    assert sum(r.taken for r in found) == sum(r.size for r in found)
    uncut, _ = queue([tuple(r) for r in rows], cut=False)
    assert uncut != taken


def test_rows_without_an_id_are_shuffled(spark, shared):
    rows = [(None, f"x{i} " * (1 + i % 100), s) for s in "abc" for i in range(300)]
    found = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).filter("source = 'c'").collect()
    left, kept = ([r.size for r in found if bool(r.taken) == side] for side in (False, True))
    assert left and kept and max(left) > 90 and min(left) < 10 and max(kept) > 90 and min(kept) < 10
    again = mixing.mixed(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert Counter(again.filter("source = 'c'").collect()) == Counter(found)
