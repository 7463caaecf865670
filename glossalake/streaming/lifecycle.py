"""The life of tasks over a stream of their events, with timers: state ends with the task, or when it has been silent too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossalake.operators.tasks import MAX_RETRIES

#: Seconds without an event after which a task has failed.
TIMEOUT = 3600
_OUT = "task_id string, status string, retry_count int, reason string"


class Lifecycle(StatefulProcessor):
    """Events (task_id, seq, status, at) of a task, in whatever order they come, to its states; the last one by seq counts."""

    def __init__(self, timeout: int = TIMEOUT, retries: int = MAX_RETRIES) -> None:
        self.timeout, self.retries = timeout, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "seq long, status string, failures int, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, status, failures, seen = self.task.get() if self.task.exists() else (-1, "", 0, 0)
        for batch in rows:
            failures += int((batch["status"] == "failed").sum())
            last = batch.loc[batch["seq"].idxmax()]
            if last["seq"] >= seq:
                seq, status = int(last["seq"]), str(last["status"])
            seen = max(seen, int(batch["at"].max().timestamp() * 1000))
        again = status == "failed" and failures <= self.retries
        ended = status in ("completed", "canceled") or (status == "failed" and not again)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ended:
            self.task.clear()
        else:
            self.task.update((seq, status, failures, seen))
            self.handle.registerTimer(seen + self.timeout * 1000)
        yield self._row(key, "waiting" if again else status, failures, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, _, failures, _ = self.task.get()
        self.task.clear()
        yield self._row(key, "failed", failures, "timeout")

    def close(self) -> None:
        pass

    def _row(self, key: tuple, status: str, failures: int, reason: str | None) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "status": [status], "retry_count": [min(failures, self.retries)], "reason": [reason]})


def task_lifecycle(events: DataFrame, timeout: int = TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """task_id, status, retry_count and reason whenever a task's events arrive, and once more (failed, timeout) when none has come for ``timeout`` seconds of event time.

    A failed task waits again while retries are left. Completed, canceled and finally failed tasks leave no state, nor do those that time out: an event
    of such a task that comes later begins it anew, unless it is older than ``late`` allows, as then it is dropped. Needs the RocksDB state store.
    """
    keyed = events.withWatermark("at", late).groupBy("task_id")
    return keyed.transformWithStateInPandas(Lifecycle(timeout), _OUT, "Update", "EventTime")
