"""Spelling variants against all pairs of words, and the filters against plain sets."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import queries, spelling


def counted(rows):
    """Words and counts as the contract states them."""
    n = Counter()
    for key, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(rows):
    n = counted(rows)
    found = {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        found[w] = best if best is not None and n[best] >= 2 * n[w] else None, len(others)
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        yield (w, form, root, n[w], n_near, n[form] if form else None)


def operator(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(map(tuple, spelling.spelling_groups(docs, **more).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    """Chains of variants, doubled letters, ties, accents, one very long word, and null ids."""
    rng = np.random.default_rng(3)
    words = ["letter", "leter", "lettter", "lettr", "xetter", "straße", "strasse", "élève", "eleve"]
    words += ["abcde", "abcdef", "abcdefg", "abcdxfg", "x" * 300, "x" * 299, "y" + "x" * 299]
    words += ["".join(rng.choice([*"aabcé"], rng.integers(4, 8))) for _ in range(120)]
    rows = [(3, None), (4, ""), (5, "quartzo " * 40 + "quartzoi " * 12 + "quartzoie " * 4)]
    for k in range(60):
        often = rng.choice(len(words), 50, p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1)))
        glue = rng.choice([" ", ", ", "_", "×", "1", "\n"])  # × is a letter of the stated range
        text = glue.join(words[i].title() if rng.random() < 0.2 else words[i] for i in often)
        rows.append((None if k % 7 == 0 else k % 50, text))
    return rows


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 40])
def test_groups_equal_all_pairs(spark, shared, texts, filter_bytes):
    expected = sorted(grouped(texts), key=str)
    assert any(form and root != form for _, form, root, *_ in expected)
    assert operator(spark, texts, filter_bytes=filter_bytes) == expected


def test_query_equals_its_sql(spark, shared):
    root = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{root}/documents.parquet'")
    expected = connection.sql(queries.SQL["op13_spelling_variants"]).to_arrow_table()
    actual = queries.op13_spelling_variants(spark, root).toArrow()
    names = sorted(expected.column_names)
    assert names == sorted(actual.column_names) and expected.num_rows
    assert [str(expected.schema.field(c).type) for c in names] == [
        str(actual.schema.field(c).type).replace("large_", "") for c in names
    ]
    a, b = (Counter(zip(*(t[c].to_pylist() for c in names))) for t in (actual, expected))
    assert a == b


def test_hashes_of_edits_are_those_of_the_edited_words():
    texts = ["letter", "aab", "é", "zzzzz"]
    own = spelling.Words(pa.array(texts))
    hashes = dict(zip(texts, own.hashes()))

    def of(text):
        return spelling.Words(pa.array([text])).hashes()[0]

    assert all(of(t) == h for t, h in hashes.items())
    at, left = own.deletions()
    seen = set()
    for p, h in zip(at, left):
        text, i = texts[own.word[p]], own.place[p]
        short = text[:i] + text[i + 1 :]
        assert (text, short) not in seen and (not short or of(short) == h)
        seen.add((text, short))
    assert len(seen) == 5 + 2 + 1 + 1
    for at, letter, changed in own.replacements(np.array([ord(c) for c in "aez"], np.uint64)):
        for p, c, h in zip(at, letter, changed):
            text, i = texts[own.word[p]], own.place[p]
            assert "aez"[c] != text[i] and of(text[:i] + "aez"[c] + text[i + 1 :]) == h


def test_filters_hold_every_word_and_few_others(spark, shared):
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice([*"abcdefgh"], 6 + k % 3)) for k in range(6000)})
    table = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    sizes = sorted(Counter(len(w) for w in words[::2]).items())
    found = spelling.filters(table, sizes, 1, 0)
    own = spelling.Words(pa.array(words))
    hit = set(found.may_hold(own.lengths, own.hashes()).tolist())
    assert hit >= set(range(0, len(words), 2))
    assert len(hit) - len(words[::2]) < 0.01 * len(words)
    assert not len(found.may_hold(np.array([50]), np.array([1], np.uint64)))


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = spelling.spelling_groups(awkward).collect()
    expected = [(r.doc_id, r.text) for r in awkward.collect()]
    assert {r.word: r.n for r in rows} == counted(expected)
    assert spelling.spelling_groups(nothing).count() == 0
