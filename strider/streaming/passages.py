"""Passages on a stream of position samples (extension of M7; the batch engine is in operators.visibility).

A walker's view of a panel is keyed state: in view or not. A passage is counted when it turns true. State ends when the
watermark has passed a walker's last sample by the timeout, so it does not grow with the walkers that ever came.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

TIMEOUT_MS = 30 * 60 * 1000
LATE = "10 minutes"
OUT = "trip long, person long, panel_id string, ts timestamp"


def stream_passages(samples: DataFrame, timeout_ms: int = TIMEOUT_MS, late: str = LATE) -> DataFrame:
    """samples: trip, person, panel_id, ts, seq, hit (a stream). A row for each passage. Samples later than `late` are
    dropped by the watermark."""

    def step(key, batches, state):
        trip, panel_id = key
        if state.hasTimedOut:
            state.remove()
            return
        inside = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        before = rows["hit"].shift(1, fill_value=inside).astype(bool)
        new = rows[rows["hit"].astype(bool) & ~before]
        state.update((bool(rows["hit"].iloc[-1]),))
        last = int(rows["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + timeout_ms)
        yield pd.DataFrame({"trip": trip, "person": new["person"], "panel_id": panel_id, "ts": new["ts"]})

    timed = samples.withWatermark("ts", late)
    return timed.groupBy("trip", "panel_id").applyInPandasWithState(step, OUT, "inside boolean", "append", GroupStateTimeout.EventTimeTimeout)
