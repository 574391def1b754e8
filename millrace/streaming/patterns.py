"""Chains of events of one key, in a stream that may be out of order within its delay."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import interval
from .joins import above_watermark

_MICROS = timedelta(microseconds=1)


def event_chains(
    stream: DataFrame,
    ts: str,
    key: str,
    kind: str,
    event_id: str,
    steps: list[str],
    within: timedelta,
    delay: timedelta,
) -> DataFrame:
    """A row for every event of the last kind in ``steps`` that completes a chain.

    The link to the step before is the key's latest event of that kind at a strictly earlier time,
    ties to the greatest id, less than ``within`` before; it has to be linked itself back to
    the first step. Columns are the key, and ``<step>_id`` and ``<step>_at`` (microseconds since
    1970) for every step. Rows with a null key, time or id are in no chain; repeats of the last
    event come again. Events later than ``delay`` are dropped.

    Events wait in state until the watermark has passed them and are then taken in order of time, so
    state holds a key's events of the last ``delay`` and one chain for every step. The events of a
    key meet in one task; the batch form has no such limit.
    """
    if len(set(steps)) != len(steps) or len(steps) < 2:
        raise ValueError("steps have to be different, and two at least")
    complete = F.col(key).isNotNull() & F.col(event_id).isNotNull() & F.col(kind).isin(steps)
    rows = stream.withWatermark(ts, interval(delay)).filter(above_watermark(ts, complete))
    rows = rows.select(
        F.col(key).alias("key"),
        F.col(event_id).alias("id"),
        F.unix_micros(ts).alias("at"),
        F.col(kind).alias("kind"),
        ts,
    )
    columns = ", ".join(f"{step}_id bigint, {step}_at bigint" for step in steps)
    found = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Chains(steps, within // _MICROS),
        outputStructType=f"key {rows.schema['key'].dataType.simpleString()}, {columns}",
        outputMode="append",
        timeMode="eventTime",
    )
    return found.withColumnRenamed("key", key)


class _Chains(StatefulProcessor):
    def __init__(self, steps: list[str], within: int) -> None:
        self.steps, self.within = steps, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id bigint, at bigint, kind string")
        self.chains = handle.getMapState("chains", "step int", "ids array<bigint>, ats array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(int(i), int(a), str(k)) for i, a, k in zip(batch["id"], batch["at"], batch["kind"])]
            if new:
                self.waiting.appendList(new)
                least = min(at for _, at, _ in new)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter([])

    def _wake(self, at: int) -> None:
        # Timers are in milliseconds; one that is rounded up never fires before its event is passed.
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((at, i, kind) for i, at, kind in events if at <= passed)
        later = [e for e in events if e[1] > passed]
        if not ready:
            return
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(min(at for _, at, _ in later))
        chains = {int(step[0]): (list(c[0]), list(c[1])) for step, c in self.chains.iterator()}
        found = list(self._follow(ready, chains))
        for step in range(len(self.steps) - 1):
            if step in chains:
                self.chains.updateValue((step,), chains[step])
            elif self.chains.containsKey((step,)):
                self.chains.removeKey((step,))
        if found:
            names = [f"{step}_{part}" for step in self.steps for part in ("id", "at")]
            yield pd.DataFrame([(key[0], *row) for row in found], columns=["key", *names])

    def _follow(self, events: list[tuple], chains: dict[int, tuple]) -> Iterator[list[int]]:
        """Take events in order; those of one instant only see what was before it."""
        at = 0
        while at < len(events):
            until = at
            while until < len(events) and events[until][0] == events[at][0]:
                until += 1
            before = dict(chains)
            for time, event, kind in events[at:until]:
                step = self.steps.index(kind)
                known = before.get(step - 1)
                linked = step == 0 or (known is not None and time - known[1][-1] < self.within)
                ids, ats = known if step and linked else ([], [])
                if step == len(self.steps) - 1:
                    if linked:
                        yield [x for pair in zip([*ids, event], [*ats, time]) for x in pair]
                elif linked:
                    chains[step] = ([*ids, event], [*ats, time])
                else:
                    chains.pop(step, None)
            at = until
