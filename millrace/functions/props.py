"""Fields of JSON text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_json_longs(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Add fields of the JSON objects in text ``column`` as bigint; ``fields`` maps new columns
    to field names.

    All fields are read in one pass. Names are those of the top level, taken literally, dots
    included. A value counts if it is a whole number in plain digits, quoted or not, that fits
    a bigint. Anything else is null: 1.5, 1.0, 1e2, a missing field, a text that is no object.
    """
    texts = [f"_text_of_{name}" for name in fields]
    read = df.select("*", F.json_tuple(column, *fields.values()).alias(*texts))
    whole = [
        F.when(F.col(text).rlike(r"\A-?[0-9]+\z"), F.col(text).try_cast("bigint")).alias(name)
        for text, name in zip(texts, fields)
    ]
    return read.select(*df.columns, *whole)
