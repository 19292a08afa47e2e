"""A rate limit in event time: events that come late or out of order count in the window where they belong."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# the processor goes to Spark's workers as it is: those that set it up have no package to import it from
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT, WINDOW_S = 60, 60
LIMITED = "user_id long, event_id long, allowed boolean"


class Limiter(StatefulProcessor):
    """A user's pending events and open window. An event waits until the watermark has passed it, so that all before it are known."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.us = limit, seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, event_id long")
        self.window = handle.getValueState("window", "opened long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(us), int(e)) for batch in rows for us, e in zip(batch["us"], batch["event_id"], strict=True)]
        if events:
            self.pending.appendList(events)
            # one timer for all: the first to be ready; it sets the next one
            self.handle.registerTimer(min(events)[0] // 1000 + 1)
        # no frame where there is no row: one for each user and batch costs more than its state
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get())
        ready, later = [x for x in waiting if x[0] // 1000 < passed], [x for x in waiting if x[0] // 1000 >= passed]
        opened, used = self.window.get() or (None, 0)
        out = []
        for us, event in ready:
            if opened is None or us - opened >= self.us:
                opened, used = us, 0
            used += 1
            out.append((key[0], event, used <= self.limit))
        if ready:
            self.pending.put(later) if later else self.pending.clear()
            self.window.update((opened, used))
            self.handle.registerTimer(later[0][0] // 1000 + 1 if later else (opened + self.us) // 1000 + 1)
        elif later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif opened is not None and (opened + self.us) // 1000 < passed:
            # no event can fall into this window any more, and the next one opens another
            self.window.clear()
        return iter([pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])] if out else ())

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_S, late: str = "1 day") -> DataFrame:
    """user_id, event_id, allowed of each event (user_id, event_id, ts) that the watermark has passed.

    A window opens at a user's first event behind the last window, in order of time and id, whatever order they came
    in; events later than the watermark are dropped by it. State is a user's events of that delay and one window, which
    is cleared when it has ended. Events without a user or time are left out. Needs the RocksDB state store.
    """
    timed = events.where("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros(F.col("ts")).alias("us"))
    return timed.groupBy("user_id").transformWithStateInPandas(Limiter(limit, seconds), LIMITED, "Append", "EventTime")
