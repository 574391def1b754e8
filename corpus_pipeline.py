"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and its
result is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, near_dedup, packing, pii
from millrace.llm.queries import PII_KEY, tokenizer_file
from millrace.workspace import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; lang becomes the predicted one.

    Rejected are texts that are null or have no letter, and texts for which the best language's
    code is no shorter than the bytes themselves.
    """
    found = language_id.predict(docs.select(*COLUMNS), language_id.fit(docs))
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < 8))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles, that of the smallest doc_id.

    Rows are compared by their texts, whether or not they have an id of their own.
    """
    return near_dedup.representatives(docs.select(*COLUMNS), words=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    replaced = pii.with_surrogates(docs.select(*COLUMNS), PII_KEY)
    return replaced.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every row as often as the mix does, in whole passes: its taken words / its size.

    Documents without words are in no mix and go. Rows that share an id, or have none, are each
    taken for themselves, in the order of a hash of their texts.
    """
    # Numbers are written once, as they depend on how the rows are cut.
    rows = docs.select(*COLUMNS).withColumn("_turn", F.xxhash64("text", "lang"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    times = mixing.mixed(rows, keep=("_turn", "_row")).select(
        "_row", F.round(F.try_divide("taken", "size")).cast("int").alias("times")
    )
    copies = rows.join(times.filter("times > 0"), "_row")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids, numbered by length."""
    return packing.packed(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("pii_surrogates", private_data),
    ("weighted_fair_mix", mix),
    ("packing", pack),
]

# Language models, minima and token ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
