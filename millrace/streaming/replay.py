"""Run a stream over all files that are there, and read back what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import SCHEMAS
from ..workspace import run_folder
from .source import FILES_PER_BATCH, event_stream

# A running stream keeps the values that hold when it starts.
STREAM_SETTINGS = {
    # State outside the JVM heap, uploaded to the checkpoint as changes only.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Joins up sessions in each map task, before a busy key is shuffled to one task.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Progress reports kept between two looks at them.
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
}


class LateEvents(RuntimeError):
    """Events came after the watermark had closed their window."""


def replay(
    spark: SparkSession,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    label: str,
    close_after: timedelta | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    drop_late: bool = False,
    folder: str | None = None,
    open_for: timedelta | None = None,
) -> DataFrame:
    """Run ``build`` over the event files at ``path`` in append mode; return its output.

    In append mode the windows that the watermark has not passed stay unwritten. With
    ``close_after`` one more event follows, that long after the last one, which moves the
    watermark past them. It has to exceed the delay plus the longest window or gap, which
    is checked where that sum is given as ``open_for``; the closing event's own window then
    stays open and unwritten.

    Files are taken oldest first, ``files_per_batch`` at a time, which keeps the state small
    where they were written in the order of event time, to within the delay. Were that wrong, the
    watermark would drop events; as a replay is meant to be whole, that raises
    :class:`LateEvents` unless ``drop_late`` is set. Late rows are counted per batch, in
    ``folder``, for any number of batches and over restarts; a batch whose count was lost
    with the driver raises too. With ``ALL_FILES`` in one batch their order does not matter.
    Jobs run when this is called.

    Output, checkpoint and closing event lie in ``folder``, by default a new one below the
    shared one. A replay whose driver was lost goes on from there when it is started again
    with the same folder; the file sink's log lets no batch appear twice.
    """
    if close_after is not None and open_for is not None and close_after <= open_for:
        raise ValueError(f"close_after has to exceed {open_for}, or windows stay unwritten")
    folder = folder or run_folder(spark, label)
    stream = event_stream(spark, path, files_per_batch)
    if close_after is not None:
        closing = f"{folder}/closing"
        events = spark.read.schema(SCHEMAS["events"]).parquet(path)
        events.limit(0).write.mode("ignore").parquet(closing)
        stream = stream.unionByName(event_stream(spark, closing))
    result = build(stream)
    if close_after is None or len(spark.read.parquet(path).inputFiles()) > files_per_batch:
        _drain(result, folder)
    if close_after is not None:
        # Within one batch nothing is late, so the event may come with the files; after
        # several batches the stream is resumed with it.
        later = F.max("ts") + F.lit(close_after)
        last = events.agg(later.alias("ts"))
        others = [
            F.lit(None).cast(field.dataType).alias(field.name)
            for field in events.schema
            if field.name != "ts"
        ]
        last.select("ts", *others).select(*events.columns).write.mode("append").parquet(closing)
        _drain(result, folder)
    if not drop_late:
        _refuse_late(spark, folder)
    return spark.read.schema(result.schema).parquet(f"{folder}/output")


def _drain(result: DataFrame, folder: str) -> None:
    """Process what is there, and note under ``folder`` how many rows each batch dropped."""
    noted: set[int] = set()
    with _settings(result.sparkSession, STREAM_SETTINGS):
        query = (
            result.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/output")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        while not query.awaitTermination(1):
            _note(query, noted, folder)
        _note(query, noted, folder)


def _note(query: StreamingQuery, noted: set[int], folder: str) -> None:
    new = {
        progress.batchId: sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        for progress in query.recentProgress
        if progress.batchId not in noted
    }
    if new:
        spark = SparkSession.active()
        counts = spark.createDataFrame(list(new.items()), "batch bigint, late bigint")
        counts.coalesce(1).write.mode("append").parquet(f"{folder}/late")
        noted.update(new)


def _refuse_late(spark: SparkSession, folder: str) -> None:
    counts = spark.read.schema("batch bigint, late bigint").parquet(f"{folder}/late")
    # A batch that ran again after a restart has several counts.
    per_batch = counts.groupBy("batch").agg(F.max("late").alias("late"))
    late, known, last = per_batch.agg(F.sum("late"), F.count("*"), F.max("batch")).first()
    if late:
        raise LateEvents(f"{late} late rows were dropped: raise the delay, or set drop_late")
    if known != last + 1:
        raise LateEvents(f"late rows of {last + 1 - known} batches were not counted")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
