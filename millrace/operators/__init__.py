"""Operators shared by the plans; each takes and returns DataFrames."""

from .asof import asof_join
from .existence import with_match, without_match
from .intervals import interval_join
from .kept import KeptSums, signed_sums
from .measures import Measures, count_rows
from .ordered import running
from .quantiles import quantiles
from .setops import except_all, except_distinct, intersect_all, intersect_distinct, union_distinct
from .subtotals import subtotals
from .topk import top_k
from .windows import sessions, sliding, tumbling

__all__ = [
    "KeptSums",
    "Measures",
    "asof_join",
    "count_rows",
    "except_all",
    "except_distinct",
    "intersect_all",
    "intersect_distinct",
    "interval_join",
    "quantiles",
    "running",
    "sessions",
    "signed_sums",
    "sliding",
    "subtotals",
    "top_k",
    "tumbling",
    "union_distinct",
    "with_match",
    "without_match",
]
