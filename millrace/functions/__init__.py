"""Column helpers built from Spark's own functions."""

from .event_time import from_instant, interval, micros, span_micros, to_instant
from .money import TEN_THOUSANDTHS, amount, hundredths, net_price
from .props import with_json_longs

__all__ = [
    "TEN_THOUSANDTHS",
    "amount",
    "hundredths",
    "from_instant",
    "interval",
    "micros",
    "net_price",
    "span_micros",
    "to_instant",
    "with_json_longs",
]
