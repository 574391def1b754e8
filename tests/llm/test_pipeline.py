"""The pipeline against plain forms of its stages, each over what the stage before kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import groups, queue
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, pii, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Real documents with null and repeated ids, exact and near copies, texts without words or letters."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()
    rows = [(*r,) for r in rows if len(r.text) < 4000][:110]
    rows += [(None, *r[1:]) for r in rows[:6]] + [(rows[9][0], *r[1:]) for r in rows[10:14]]
    rows += [(9_000 + n, r[1] + " and one word more", *r[2:]) for n, r in enumerate(rows[20:30])]
    rows += [(9_100, None, "en", None, None), (9_101, "", None, "a", 0), (9_102, "12 34", "de", "b", 5)]
    rows += [(9_103, rows[40][1] + " mail jane.roe@example.com", *rows[40][2:])]
    folder = tmp_path_factory.mktemp("made")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit("x"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_every_stage_equals_its_plain_form(spark, made):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{made}/documents.parquet")
    first = docs.collect()

    langs = stages["language_id"](spark, docs, made)
    kept = langs.collect()
    wordless = {9_100, 9_101, 9_102}
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        (r.doc_id, r.text) for r in first if r.doc_id not in wordless
    )
    was = {r.text: r.lang for r in first}
    assert np.mean([r.lang == was[r.text] for r in kept]) > 0.9

    unique = stages["minhash_near_dedup"](spark, langs, made)
    stayed = unique.collect()
    roots, _ = groups([r.text for r in kept], 5)
    least = defaultdict(lambda: (True, 0))
    for root, r in zip(roots, kept):
        least[root] = min(least[root], (r.doc_id is None, r.doc_id or 0))
    place = {(r.doc_id, r.text): root for root, r in zip(roots, kept)}
    assert sorted(place[r.doc_id, r.text] for r in stayed) == sorted(least)
    assert all(least[place[r.doc_id, r.text]] == (r.doc_id is None, r.doc_id or 0) for r in stayed)

    private = stages["pii_surrogates"](spark, unique, made)
    clean = private.collect()
    assert len(clean) == len(stayed) and all(r.n_chars == len(r.text) for r in clean)
    assert not any("jane.roe@example.com" in r.text for r in clean)
    # A text's surrogates do not depend on the texts around it.
    alone = unique.limit(20)
    own = pii.with_surrogates(alone, queries.PII_KEY).collect()
    assert {(r.doc_id, r.text) for r in own} <= {(r.doc_id, r.text) for r in clean}

    mixed = stages["weighted_fair_mix"](spark, private, made).collect()
    turn = F.xxhash64("text", "lang")
    keyed = private.select("source", "doc_id", mixing.word_count("text"), F.xxhash64(F.lit(10), "doc_id", "text"), "text", turn)
    given = keyed.collect()
    taken, _ = queue([tuple(r)[:4] for r in given])
    times = Counter()
    for r, words in zip(given, taken):
        if r[2]:
            times[r.doc_id, r.text] += int(words / r[2] + 0.5)
    assert Counter((r.doc_id, r.text) for r in mixed) == +times


def test_the_run_packs_all_that_was_mixed(spark, made):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{made}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, made)
        assert docs.columns == corpus_pipeline.COLUMNS
    whole = Tokenizer.from_file(queries.tokenizer_file())
    expected = Counter()
    for r in docs.collect():
        ids = np.array(whole.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for length in queries.packing.lengths(len(ids)):
            expected[r.doc_id, at, ids[at : at + length].tobytes()] += 1
            at += length
    found = corpus_pipeline.run(spark, made).collect()
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in found) == expected
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_an_empty_table_passes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
