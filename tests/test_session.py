"""Sessions and shared folders, each in a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def run(code: str, conf: Path) -> list[str]:
    environment = {**os.environ, "SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(REPO)}
    done = subprocess.run(
        [sys.executable, "-c", code],
        env=environment,
        capture_output=True,
        text=True,
        timeout=120,
        check=True,
    )
    return done.stdout.split()


def test_cluster_defaults_win_over_ours_and_callers_over_both(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text(
        "spark.ui.enabled false\n"
        "spark.sql.adaptive.advisoryPartitionSizeInBytes 64m\n"
        "spark.sql.session.timeZone Asia/Tokyo\n"
        f"spark.checkpoint.dir {tmp_path}/shared\n"
    )
    code = """
from millrace.session import session
from millrace.workspace import run_folder, shared_root
spark = session("t", "local[1]", 3, {"spark.sql.session.timeZone": "Europe/Oslo"})
print(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
print(spark.conf.get("spark.sql.session.timeZone"))
print(spark.conf.get("spark.sql.shuffle.partitions"))
print(spark.conf.get("spark.sql.files.maxPartitionBytes"))
print(session("again") is spark)
print(shared_root(spark))
print(run_folder(spark, "x") != run_folder(spark, "x"))
"""
    assert run(code, tmp_path) == [
        "64m", "Europe/Oslo", "3", "128m", "True",
        f"{tmp_path}/shared", "True",
    ]


def test_local_session_without_a_shared_folder_gets_a_temporary_one(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("spark.ui.enabled false\n")
    code = """
from millrace.session import session
from millrace.workspace import shared_root, written
spark = session("t", "local[1]", 1)
print(shared_root(spark) == shared_root(spark))
print(written(spark.range(5), "five").count())
"""
    assert run(code, tmp_path) == ["True", "5"]


def test_zones_of_python_and_session_do_not_move_a_date_filter(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("spark.ui.enabled false\n")
    code = """
import os, time
os.environ["TZ"] = "Pacific/Auckland"
time.tzset()
from datetime import datetime
from millrace.session import session
from millrace.plans.joins import in_year
spark = session("t", "local[1]", 1, {"spark.sql.session.timeZone": "America/New_York"})
days = ["1996-12-31 23:59:59", "1997-01-01 00:00:00"]
days += ["1997-12-31 23:59:59", "1998-01-01 00:00:00"]
df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("cast(d as timestamp_ntz) as ts")
print(*[int(r[0]) for r in df.select(in_year("ts", 1997)).collect()])
"""
    assert run(code, tmp_path) == ["0", "1", "1", "0"]


class _Cluster:
    """Stands in for a cluster session; a real one can't be started in a test."""

    def __init__(self, conf: dict, given: str | None = None) -> None:
        self.sparkContext = self
        self.master = "yarn"
        self.conf = conf
        self.getCheckpointDir = lambda: given


def test_cluster_without_a_shared_folder_is_refused():

    from millrace.workspace import shared_root

    assert shared_root(_Cluster({"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    assert shared_root(_Cluster({}, "hdfs:///d")) == "hdfs:///d"
    with pytest.raises(RuntimeError):
        shared_root(_Cluster({}))
