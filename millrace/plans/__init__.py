"""Registered queries and, under the same names, their SQL for an independent engine.

``REPORTS`` take the tables, wherever they are kept; ``QUERIES`` take a session and the
folder of their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import Tables
from . import (
    distributions,
    event_windows,
    joins,
    kept_reports,
    ordering,
    props,
    rankings,
    sets,
    streams,
    subtotal_reports,
    timed_joins,
)

_MODULES = (
    joins,
    subtotal_reports,
    rankings,
    ordering,
    sets,
    props,
    event_windows,
    timed_joins,
    distributions,
    kept_reports,
    streams,
)

REPORTS = {name: report for module in _MODULES for name, report in module.REPORTS.items()}


def _on_files(report: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: report(Tables(spark, root))


QUERIES = {name: _on_files(report) for name, report in REPORTS.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
