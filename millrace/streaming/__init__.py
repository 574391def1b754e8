"""Structured Streaming forms of the event jobs."""

from .joins import Side, pairs_within
from .patterns import event_chains
from .replay import LateEvents, replay
from .source import ALL_FILES, FILES_PER_BATCH, event_stream
from .windows import deduplicated, session_windows, sliding_windows, tumbling_windows

__all__ = [
    "ALL_FILES",
    "FILES_PER_BATCH",
    "LateEvents",
    "Side",
    "deduplicated",
    "event_chains",
    "event_stream",
    "pairs_within",
    "replay",
    "session_windows",
    "sliding_windows",
    "tumbling_windows",
]
