"""The corpus tables, read by name from one folder that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import written

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def remainder(key: str, parts: int):
    """crc32 of a key written as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def even_sample(df: DataFrame, per: str, keys: list[str], about: int) -> DataFrame:
    """About ``about`` rows for each value of column ``per``, all where there are fewer.

    Rows are drawn by a hash of ``keys`` below a limit set by the value's count, so the same rows
    are drawn in every run and no group meets in one task. Rows that are equal in ``per`` and
    ``keys`` are drawn together and then count once, so that a row repeated very often can't
    make the sample larger. Rows with a null in any of these columns are left out. Runs a job that counts.
    """
    for column in (per, *keys):
        df = df.filter(F.col(column).isNotNull())
    counts = df.groupBy(F.col(per).alias("_per")).agg(F.count("*").alias("_rows"))
    # Written, so that Spark broadcasts it only while it is known to be small.
    counts = written(counts, "counts")
    draw = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 40))
    limit = F.lit(about) / F.col("_rows") * F.lit(float(1 << 40))
    joined = df.join(counts, F.col(per) == F.col("_per"))
    return joined.filter(draw < limit).select(*df.columns).dropDuplicates([per, *keys])
