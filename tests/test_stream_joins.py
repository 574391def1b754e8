"""Pairs and chains of events in streams over several files, against plain forms."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import micros
from millrace.sources import SCHEMAS
from millrace.streaming import ALL_FILES, Side, event_chains, pairs_within, replay

START = datetime(2024, 1, 1)
HOUR, HALF = timedelta(hours=1), timedelta(minutes=30)
STEPS = ["view", "click", "purchase"]


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Four files that reach back behind one another, with ties, a hot user, nulls and repeats."""
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("feed")
    everything = []
    (folder / "events").mkdir()
    for n in range(4):
        rows = []
        for i in range(150):
            minute = 180 * n - 50 * (n > 0) + rng.randrange(0, 225)
            user = rng.choice([1, 1, 2, 3, None])
            rows.append((1000 * n + i, START + timedelta(minutes=minute), user, rng.choice([*STEPS, "error"]), 1.0, None))
        rows += rows[:5]
        everything += rows
        part = folder / f"part-{n}"
        spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1).write.parquet(str(part))
        (written,) = part.glob("*.parquet")
        copy = folder / "events" / f"{n}.parquet"
        copy.write_bytes(written.read_bytes())
        os.utime(copy, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder / "events"), everything


def side(stream, kind):
    columns = {f"{kind}_id": F.col("event_id"), f"{kind}_user": F.col("user_id")}
    return Side(stream, "ts", HOUR, columns, f"{kind}_ts", F.col("event_type") == kind)


@pytest.mark.parametrize("files_per_batch", [ALL_FILES, 1])
@pytest.mark.parametrize("outer", [True, False])
def test_pairs_equal_all_pairs(spark, feed, outer, files_per_batch):
    path, rows = feed

    def build(stream):
        pairs = pairs_within(side(stream, "view"), side(stream, "purchase"), {"view_user": "purchase_user"}, HALF, outer)
        return pairs.select("view_id", "purchase_id")

    found = replay(spark, path, build, "pairs", timedelta(hours=3), files_per_batch=files_per_batch)
    expected = Counter()
    for a in (r for r in rows if r[3] == "view"):
        own = [
            b[0] for b in rows
            if b[3] == "purchase" and a[2] is not None and b[2] == a[2] and a[1] <= b[1] < a[1] + HALF
        ]
        expected.update((a[0], b) for b in own or ([None] if outer else []))
    assert Counter(map(tuple, found.collect())) == expected and expected


@pytest.mark.parametrize("files_per_batch", [ALL_FILES, 1])
def test_chains_equal_a_search(spark, feed, files_per_batch):
    path, rows = feed

    def build(stream):
        return event_chains(stream, "ts", "user_id", "event_type", "event_id", STEPS, HALF, HOUR)

    found = replay(spark, path, build, "chains", timedelta(hours=3), files_per_batch=files_per_batch)

    def before(row, kind):
        earlier = [r for r in rows if r[3] == kind and r[2] == row[2] and r[1] < row[1]]
        last = max(earlier, key=lambda r: (r[1], r[0]), default=None)
        return last if last and row[1] - last[1] < HALF else None

    expected = Counter()
    for row in (r for r in rows if r[3] == "purchase" and r[2] is not None):
        click = before(row, "click")
        view = click and before(click, "view")
        if view:
            expected[(row[2], view[0], click[0], row[0])] += 1
    assert Counter((r.user_id, r.view_id, r.click_id, r.purchase_id) for r in found.collect()) == expected
    assert len(expected) > 10
    first = found.filter("user_id = 1").first()
    at = spark.range(1).select(micros(F.lit(next(r[1] for r in rows if r[0] == first.purchase_id)).cast("timestamp_ntz"))).first()[0]
    assert first.purchase_at == at


def test_a_rare_kind_does_not_hold_back_the_watermark(spark, feed):
    path, rows = feed

    def build(stream):
        rare = Side(stream, "ts", HOUR, {"none_id": F.col("event_id")}, "none_ts", F.col("event_type") == "none")
        return pairs_within(side(stream, "view"), rare, {"view_id": "none_id"}, HALF, outer=True)

    found = replay(spark, path, build, "rare", timedelta(hours=3), files_per_batch=1)
    assert found.count() == sum(r[3] == "view" for r in rows)


def test_steps_have_to_differ(spark, feed):
    with pytest.raises(ValueError):
        event_chains(spark.range(1), "ts", "a", "b", "c", ["view", "view"], HALF, HOUR)
