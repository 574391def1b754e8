from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


@pytest.fixture(scope="session")
def shared(spark):
    """All operators may write to the session's shared folder."""
    return spark


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and a column with a clashing name."""
    long = " ".join(f"wort{i % 977} token = secret{i:08d}" for i in range(20_000))
    rows = [
        (1, "the cat sat on the mat and then it went home", "en", "a", 44, "x"),
        (1, "the cat sat on the mat and then it went home", "en", "a", 44, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "a", 0, "x"),
        (None, "the cat sat on the mat and then it went home", "en", "b", 44, "x"),
        (4, long, "de", "b", len(long), "x"),
        (5, " \t\n ", "de", "b", 4, "x"),
        (6, "der hund", "de", "c", 8, "x"),
        (7, "1234 5678", "de", "c", 9, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
