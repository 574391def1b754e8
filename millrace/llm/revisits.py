"""Resolution of not-modified revisits in web captures.

A revisit record says that a page was asked for again and had not changed (status 304). It is
resolved by an as-of join: the latest earlier full response of the same canonical URL. The
validators of both have to agree, and the fields that a 304 may update replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written

# Header fields that a not-modified response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that name where a visitor came from.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: str) -> Column:
    """Host in lower case without scheme, ``www.`` and default port, path, and sorted query.

    Fragment, tracking parameters and a trailing slash go. Null for null.
    """
    plain = F.regexp_replace(F.trim(F.col(url)), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    parts = F.filter(
        F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")
    )
    joined = F.array_join(parts, "&")
    return F.concat(host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(captures: DataFrame, pieces: int | None = None) -> DataFrame:
    """Return one row per capture: record_id, url_key, captured_at, kind, state, refers_to, headers.

    ``captures`` has record_id (bigint), url, captured_at (any ordered type), kind ('response' or
    'revisit') and headers (map of lower-case names to values, null reads as empty); other
    columns are ignored. Captures follow one another by captured_at, then record_id; null
    times come first. state is ``response`` for a response; for a revisit ``resolved``,
    ``mismatch`` (validators differ), ``unvalidated`` (no validator on both sides: etag is
    compared, weakly, where both have one, else last-modified) or ``orphan`` (no earlier
    response, or a null url). refers_to and merged headers are set for resolved revisits only;
    other records keep their own headers. Repeated rows repeat. An empty table gives an empty result.

    Captures are cut by range of URL and time and written once, so that one URL may span many
    tasks; the last response of each piece is carried to the next. Needs ``spark.checkpoint.dir``.
    """
    spark = captures.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select(
        "record_id",
        canonical_url("url").alias("url_key"),
        "captured_at",
        "kind",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    cut = rows.repartitionByRange(pieces, "url_key", "captured_at", "record_id")
    cut = written(cut.withColumn("_piece", F.spark_partition_id()), "captures")

    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    earlier = (
        Window.partitionBy("_piece", "url_key")
        .orderBy("captured_at", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    here = cut.withColumn("_here", F.last(full, ignorenulls=True).over(earlier))
    ends = cut.filter("kind = 'response' and url_key is not null").groupBy("_piece", "url_key")
    ends = ends.agg(F.max_by(F.struct("record_id", "headers"), F.struct("captured_at", "record_id")).alias("_end"))
    # A piece begins with the URL on which the one before may have ended; all others begin in it.
    firsts = cut.groupBy("_piece").agg(F.min("url_key").alias("url_key"))
    carried = (
        firsts.select("_piece", "url_key")
        .join(ends.withColumnRenamed("_piece", "_from"), "url_key")
        .filter("_from < _piece")
        .groupBy("_piece", "url_key")
        .agg(F.max_by("_end", "_from").alias("_carried"))
    )
    stored = F.coalesce("_here", "_carried")
    joined = here.join(carried, ["_piece", "url_key"], "left").withColumn("_full", stored)

    def field(name: str, of: str) -> Column:
        return F.element_at(F.col(of), name)

    tags = _weak(field("etag", "headers")), _weak(field("etag", "_full.headers"))
    dates = field("last-modified", "headers"), field("last-modified", "_full.headers")
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    state = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("url_key").isNull() | F.col("_full").isNull(), "orphan")
        .when(same.isNull(), "unvalidated")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("_full.headers", lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    resolved = F.col("state") == "resolved"
    return joined.withColumn("state", state).select(
        "record_id",
        "url_key",
        "captured_at",
        "kind",
        "state",
        F.when(resolved, F.col("_full.record_id")).alias("refers_to"),
        F.when(resolved, F.map_concat(kept, updates)).otherwise(F.col("headers")).alias("headers"),
    )
