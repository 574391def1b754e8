"""Streams over several files: batches, restarts, late and repeated events."""

from __future__ import annotations

import os
import sys
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import from_instant, hundredths
from millrace.operators import count_rows, sessions, sliding, tumbling
from millrace.sources import SCHEMAS
from millrace.streaming import (
    ALL_FILES,
    LateEvents,
    deduplicated,
    replay,
    session_windows,
    sliding_windows,
    tumbling_windows,
)
from millrace.streaming.windows import _first_per_batch

START = datetime(2024, 1, 1)
HOUR, QUARTER, GAP = timedelta(hours=1), timedelta(minutes=15), timedelta(minutes=30)


def measures():
    return {"n": count_rows(), "total": ("sum", hundredths("value"))}


def rows(df) -> Counter:
    return Counter(df.select(*sorted(df.columns)).collect())


def event(event_id: int, minute: float, user: int = 1) -> tuple:
    return (event_id, START + timedelta(minutes=minute), user, "view", event_id / 100, None)


@pytest.fixture
def feed(spark, tmp_path):
    """Write one parquet file per list of events, in the order they are to be read."""

    def write(*files: list[tuple]) -> str:
        folder = tmp_path / "events"
        folder.mkdir()
        for n, events in enumerate(files):
            part = tmp_path / f"part-{n}"
            spark.createDataFrame(events, SCHEMAS["events"]).coalesce(1).write.parquet(str(part))
            (written,) = part.glob("*.parquet")
            copy = folder / f"{n}.parquet"
            copy.write_bytes(written.read_bytes())
            os.utime(copy, (1_700_000_000 + n, 1_700_000_000 + n))
        return str(folder)

    return write


def hourly(stream, delay=HOUR):
    return tumbling_windows(stream, "ts", HOUR, ["user_id"], measures(), delay)


@pytest.fixture
def out_of_order(feed):
    """Three files, each reaching back half an hour behind the end of the one before."""
    files = [
        [event(100 * n + i, 120 * n - 30 + 11 * ((i * 7) % 14), user=i % 3) for i in range(14)]
        for n in range(3)
    ]
    return feed(*files)


FORMS = {
    "tumbling": (
        lambda s: tumbling_windows(s, "ts", HOUR, ["user_id"], measures(), HOUR),
        lambda d: tumbling(d, "ts", HOUR, ["user_id"], measures()),
    ),
    "sliding": (
        lambda s: sliding_windows(s, "ts", HOUR, QUARTER, ["user_id"], measures(), HOUR),
        lambda d: sliding(d, "ts", HOUR, QUARTER, ["user_id"], measures()),
    ),
    "sessions": (
        lambda s: session_windows(s, "ts", GAP, ["user_id"], measures(), HOUR),
        lambda d: sessions(d, "ts", GAP, ["user_id"], measures()),
    ),
}


@pytest.mark.parametrize("files_per_batch", [ALL_FILES, 1, 2])
@pytest.mark.parametrize("form", FORMS)
def test_stream_gives_the_batch_result(spark, out_of_order, form, files_per_batch):
    build, whole = FORMS[form]
    streamed = replay(
        spark, out_of_order, build, form, timedelta(hours=3), files_per_batch=files_per_batch
    )
    table = spark.read.schema(SCHEMAS["events"]).parquet(out_of_order)
    assert table.count() == 42
    assert rows(streamed) == rows(whole(table))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_session_zone_does_not_move_windows(spark, out_of_order, zone):
    build, whole = FORMS["tumbling"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        streamed = replay(spark, out_of_order, build, "zone", timedelta(hours=3))
        table = spark.read.schema(SCHEMAS["events"]).parquet(out_of_order)
        assert rows(streamed) == rows(whole(table))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_open_windows_stay_unwritten_without_a_closing_event(spark, feed):
    path = feed([event(1, 0), event(2, 59), event(3, 61), event(4, 200)])
    result = replay(spark, path, hourly, "open")
    assert [(r.window_start, r.n) for r in result.orderBy("window_start").collect()] == [
        (START, 2),
        (START + HOUR, 1),
    ]


def test_late_events_are_refused_or_dropped(spark, feed):
    # A batch drops what the watermark of the batch before had closed: event 3 of the
    # third file. Event 4 is behind that watermark as well, but its window is open.
    path = feed(
        [event(1, 10), event(2, 300)],
        [event(6, 301)],
        [event(3, 50), event(4, 241)],
        [event(5, 400)],
    )
    build = lambda stream: hourly(stream, timedelta(minutes=30))
    with pytest.raises(LateEvents):
        replay(spark, path, build, "late", timedelta(hours=3), files_per_batch=1)
    kept = replay(
        spark, path, build, "late", timedelta(hours=3), files_per_batch=1, drop_late=True
    )
    assert [(r.window_start, r.n) for r in kept.orderBy("window_start").collect()] == [
        (START, 1),
        (START + 4 * HOUR, 1),
        (START + 5 * HOUR, 2),
        (START + 6 * HOUR, 1),
    ]


def test_late_events_count_with_a_delay_that_covers_them(spark, feed):
    path = feed([event(1, 10), event(2, 300)], [event(6, 301)], [event(3, 50)], [event(5, 400)])
    build = lambda stream: hourly(stream, timedelta(hours=5))
    result = replay(spark, path, build, "patient", timedelta(hours=9), files_per_batch=1)
    first = result.orderBy("window_start").first()
    assert (first.window_start, first.n) == (START, 2)


def test_repeats_are_dropped_across_batches_within_the_delay(spark, feed):
    path = feed(
        [event(1, 0), event(2, 5), event(2, 5)],
        [event(1, 0), event(3, 30)],
        [event(3, 30), event(4, 300)],
    )

    def once(stream):
        kept = deduplicated(stream, "ts", ["event_id"], HOUR)
        return kept.withColumn("ts", from_instant("ts"))

    result = replay(spark, path, once, "once", files_per_batch=1)
    assert sorted(r.event_id for r in result.collect()) == [1, 2, 3, 4]


def test_key_with_very_many_copies_is_thinned_before_the_shuffle(spark, feed):
    path = feed([event(7 if i % 3 == 0 else i, i / 100) for i in range(6000)])

    def once(stream):
        once = deduplicated(stream, "ts", ["event_id"], HOUR, thin=True)
        return once.withColumn("ts", from_instant("ts"))

    result = replay(spark, path, once, "copies")
    assert result.count() == result.select("event_id").distinct().count() == 4000
    arrow = spark.read.schema(SCHEMAS["events"]).parquet(path).toArrow().to_batches()
    thinned = list(_first_per_batch(["event_id"])(iter(arrow)))
    assert sum(b.num_rows for b in thinned) <= 4000 + len(arrow)


def test_thinning_keeps_the_first_row_of_each_key_and_nulls():
    batch = pa.record_batch(
        {"a": [1, None, 1, None, 2], "b": ["x", "x", "x", "x", None], "c": [*range(5)]}
    )
    (thinned,) = _first_per_batch(["a", "b"])(iter([batch]))
    assert sorted(thinned["c"].to_pylist()) == [0, 1, 4]


def test_busy_user_is_merged_before_the_shuffle(spark, feed):
    path = feed([event(i, i / 10, user=1) for i in range(3000)])
    build, whole = FORMS["sessions"]
    result = replay(spark, path, build, "busy", timedelta(hours=3))
    assert [(r.user_id, r.n) for r in result.collect()] == [(1, 3000)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(
        "HDFSBackedStateStoreProvider"
    )  # the stream's own settings are not left behind


@pytest.mark.parametrize("files_per_batch, lost_in", [(ALL_FILES, 1), (1, 1), (1, 2)])
def test_replay_goes_on_after_a_lost_driver(
    spark, out_of_order, tmp_path, monkeypatch, files_per_batch, lost_in
):
    from millrace.streaming import replay as function

    module = sys.modules[function.__module__]
    drain, calls = module._drain, []

    def losing(result, folder):
        calls.append(folder)
        drain(result, folder)
        if len(calls) == lost_in:
            raise ConnectionError("driver lost")

    folder = str(tmp_path / "run")
    build, whole = FORMS["sliding"]
    arguments = (spark, out_of_order, build, "resumed", timedelta(hours=3))
    monkeypatch.setattr(module, "_drain", losing)
    with pytest.raises(ConnectionError):
        replay(*arguments, files_per_batch=files_per_batch, folder=folder)
    resumed = replay(*arguments, files_per_batch=files_per_batch, folder=folder)
    table = spark.read.schema(SCHEMAS["events"]).parquet(out_of_order)
    assert rows(resumed) == rows(whole(table))


def test_table_may_be_a_folder(spark, out_of_order):
    table = spark.read.schema(SCHEMAS["events"]).parquet(out_of_order)
    result = replay(spark, out_of_order + "/", hourly, "folder", timedelta(hours=3))
    assert result.agg(F.sum("n")).first()[0] == table.count()


def test_a_late_event_is_told_after_more_than_a_hundred_batches(spark, feed):
    files = [[event(i, 60 * i)] for i in range(104)]
    files[4] = [event(4, 0)]  # the batch before began with a watermark past its window
    build = lambda stream: hourly(stream, timedelta(minutes=1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a batch is quicker so
    try:
        with pytest.raises(LateEvents):
            replay(spark, feed(*files), build, "many", timedelta(hours=3), files_per_batch=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_late_event_before_a_lost_driver_is_told(spark, feed, tmp_path):
    path = feed(
        [event(1, 0)], [event(2, 600)], [event(5, 601)], [event(3, 1)], [event(4, 700)]
    )
    build = lambda stream: hourly(stream, timedelta(minutes=1))
    given = dict(close_after=timedelta(hours=3), files_per_batch=1, folder=str(tmp_path / "run"))
    for _ in range(2):
        with pytest.raises(LateEvents):
            replay(spark, path, build, "again", **given)


def test_an_event_in_the_batch_after_the_watermark_moved_still_counts(spark, feed):
    # Rows are late by the watermark that the batch before began with.
    path = feed([event(1, 0)], [event(2, 600)], [event(3, 1)], [event(4, 700)])
    build = lambda stream: hourly(stream, timedelta(minutes=1))
    result = replay(spark, path, build, "next", timedelta(hours=3), files_per_batch=1)
    assert [(r.window_start, r.n) for r in result.orderBy("window_start").collect()] == [
        (START, 2),
        (START + 10 * HOUR, 1),
        (START + 11 * HOUR, 1),
    ]


def test_a_short_closing_time_is_refused(spark, feed):
    short = timedelta(minutes=1)
    with pytest.raises(ValueError):
        replay(spark, feed([event(1, 0)]), hourly, "short", short, open_for=2 * HOUR)
