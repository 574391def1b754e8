from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import session  # noqa: E402

NO_UI = {"spark.ui.enabled": "false"}
WAREHOUSE = {"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-")}


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", master="local[8]", shuffle_partitions=8, settings=NO_UI | WAREHOUSE)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
