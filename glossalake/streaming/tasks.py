"""Task state over a stream of events (an extension: plain tables fold by ``operators.tasks.fold_events``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossalake.operators.tasks import MAX_RETRIES


def task_states(events: DataFrame) -> DataFrame:
    """An updated row (task_id, status, retry_count) whenever events (task_id, seq, status) of a task arrive; late ones with an older seq only count failures."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, failures = state.get if state.exists else (-1, "", 0)
        for batch in batches:
            failures += int((batch["status"] == "failed").sum())
            last = batch.loc[batch["seq"].idxmax()]
            if last["seq"] >= seq:
                seq, status = int(last["seq"]), str(last["status"])
        state.update((seq, status, failures))
        shown = "waiting" if status == "failed" and failures <= MAX_RETRIES else status
        yield pd.DataFrame({"task_id": [key[0]], "status": [shown], "retry_count": [min(failures, MAX_RETRIES)]})

    return events.groupBy("task_id").applyInPandasWithState(update, "task_id string, status string, retry_count int", "seq long, status string, failures long", "update", GroupStateTimeout.NoTimeout)
