"""Run every query on enlarged tables in which one key holds a third of all rows.

Not collected by pytest: ``python tests/skew_check.py FOLDER [COPIES]``. The tables of
sf0.1 are copied COPIES times under new keys into FOLDER (left as it is if it exists), and
results are compared with SQL inside DuckDB. Prints seconds per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path
from uuid import uuid4

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.operators import running  # noqa: E402
from millrace.plans import QUERIES, SQL  # noqa: E402
from millrace.session import session  # noqa: E402
from millrace.sources import SCHEMAS, Tables  # noqa: E402

SOURCE = "/root/testdata/sf0.1"


def enlarge(spark: SparkSession, folder: Path, copies: int) -> None:
    tables = Tables(spark, SOURCE)

    def copied(df: DataFrame, key: str) -> DataFrame:
        step = df.agg(F.max(key)).first()[0] + 1
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return df.withColumn("copy", copy).withColumn(key, F.col(key) + F.col("copy") * step)

    def hot(column: str, value: int, *by: str):
        third = F.pmod(F.xxhash64(*by), F.lit(3)) == 0
        return F.when(third, F.lit(value).cast("bigint")).otherwise(F.col(column))

    lines = copied(tables.lineitem, "l_orderkey")
    made = {
        "lineitem": lines.withColumns(
            {
                "l_orderkey": hot("l_orderkey", 5, *lines.columns),
                "l_partkey": hot("l_partkey", 3, "l_tax", *lines.columns),
            }
        ),
        "orders": copied(tables.orders, "o_orderkey").withColumn(
            "o_custkey", hot("o_custkey", 7, "o_orderkey")
        ),
        "events": copied(tables.events, "event_id").withColumn(
            "user_id", hot("user_id", 7, "event_id")
        ),
    }
    for name in SCHEMAS:
        df = made[name].drop("copy") if name in made else getattr(tables, name)
        files = 32 if name in made else 1
        df.repartition(files).write.parquet(str(folder / f"{name}.parquet"))


def main() -> None:
    folder = Path(sys.argv[1])
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    only = sys.argv[3].split(",") if len(sys.argv) > 3 else [*QUERIES, "running_in_pieces"]
    spark = session(
        "skew",
        master="local[8]",
        shuffle_partitions=64,
        settings={"spark.driver.memory": "10g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not folder.exists():
        enlarge(spark, folder, copies)

    def in_pieces(spark: SparkSession, root: str) -> DataFrame:
        events = Tables(spark, root).events.select("user_id", "event_id", "ts")
        return running(
            events, ["user_id"], ["ts", "event_id"], {"n": F.lit(1).cast("bigint")},
            {"previous_ts": "ts"}, max_group_rows=100_000, piece_rows=50_000,
        )

    queries = {**QUERIES, "running_in_pieces": in_pieces}
    texts = {
        **SQL,
        "running_in_pieces": """
            select user_id, event_id, ts, row_number() over w as n, lag(ts) over w as previous_ts
            from events window w as (partition by user_id order by ts, event_id)
        """,
    }
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(
            f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'"
        )
    for name in only:
        out = f"{folder}-out/{name}-{uuid4().hex}"
        start = time.perf_counter()
        queries[name](spark, str(folder)).write.parquet(out)
        seconds = time.perf_counter() - start
        ours = f"select * from '{out}/*.parquet'"
        columns = ", ".join(f'"{c[0]}"' for c in connection.execute(f"describe {ours}").fetchall())
        ours, theirs = (f"select {columns} from ({text})" for text in (ours, texts[name]))
        rows, = connection.execute(f"select count(*) from ({ours})").fetchone()
        wrong, = connection.execute(
            f"select count(*) from (({ours} except all {theirs}) union all"
            f" ({theirs} except all {ours}))"
        ).fetchone()
        print(f"{name:40} {seconds:7.2f} s {rows:10} rows, {wrong} differ", flush=True)


if __name__ == "__main__":
    main()
