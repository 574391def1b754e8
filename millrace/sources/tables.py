"""The star schema and the event table, each a parquet file or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared, so that opening a table starts no job to read a footer, and so that the
# same text serves the stream reader, which requires a schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


_CHECKED: set[tuple[str, str]] = set()


class Tables:
    """Named tables below one folder, read lazily: ``Tables(spark, root).orders``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        self._check(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def _check(self, name: str) -> None:
        """Refuse files that lack a declared column, which would otherwise read as null.

        A footer is read once per application and path.
        """
        key = (self.spark.sparkContext.applicationId, self.path(name))
        if key not in _CHECKED:
            there = set(self.spark.read.parquet(self.path(name)).columns)
            declared = [field.split()[0] for field in SCHEMAS[name].split(", ")]
            if missing := [column for column in declared if column not in there]:
                raise ValueError(f"{self.path(name)} has no column {', '.join(missing)}")
            _CHECKED.add(key)


class CatalogTables:
    """The same tables from a database of the session catalog, for instance bucketed ones."""

    def __init__(self, spark: SparkSession, database: str) -> None:
        self.spark = spark
        self.database = database

    def path(self, name: str) -> str:
        """Where the table's files are, for stream readers."""
        rows = self.spark.sql(f"describe formatted {self.database}.{name}")
        return rows.filter("col_name = 'Location'").first()["data_type"].removeprefix("file:")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.table(f"{self.database}.{name}")
