"""When a session is to be extracted, as a stream with timers.

Deltas of a session wait for a while after the first of them, so that many
become one extraction. The end of a session fires at once. A session whose job
failed keeps its back-off: new deltas join that job, and neither they nor the
end set a time of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event can be: a delta came; the session ended; its job failed; its
#: job, tried again, is done.
EVENTS = ("delta", "end", "failed", "done")
OUT = "session_id string, reason string, n long, fired_ms long"
#: The state store that timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounce(StatefulProcessor):
    """State of a session: how many deltas wait, when they fire (0: never by
    themselves), and whether its job failed."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "n long, fires long, failed boolean")

    def _get(self) -> tuple[int, int, bool]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, False)

    def _put(self, n: int, fires: int, failed: bool) -> None:
        if n or failed:
            self.state.update((n, fires, failed))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, fires, failed = self._get()
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        events = [e for pdf in rows for e in pdf.sort_values("at", kind="stable")["event"]]
        for event in events:
            if event == "delta":
                n += 1
                if not failed and not fires:
                    fires = now + self.wait_ms
                    self.handle.registerTimer(fires)
            elif event == "end":
                if n and not failed:
                    out.append((key[0], "end", n, now))
                    self.handle.deleteTimer(fires)
                    n, fires = 0, 0
            elif event == "failed":
                if fires:
                    self.handle.deleteTimer(fires)
                fires, failed = 0, True
            elif event == "done":
                n, failed = 0, False
        self._put(n, fires, failed)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "reason", "n", "fired_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, fires, failed = self._get()
        if n and fires == expiredTimerInfo.getExpiryTimeInMs():
            self._put(0, 0, failed)
            yield pd.DataFrame([(key[0], "wait", n, timerValues.getCurrentProcessingTimeInMs())], columns=["session_id", "reason", "n", "fired_ms"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, wait_seconds: float = 600) -> DataFrame:
    """session_id, reason (wait or end), n (deltas) and fired_ms on a stream of
    events (session_id, event, at), at each session's time. Events of one batch
    are taken in the order of `at`; unknown ones do nothing; null sessions are
    dropped. The session must use the state store PROVIDER."""
    keyed = events.filter("session_id is not null").selectExpr("cast(session_id as string) as session_id", "event", "at").groupBy("session_id")
    return keyed.transformWithStateInPandas(Debounce(int(wait_seconds * 1000)), OUT, "Append", "ProcessingTime")
