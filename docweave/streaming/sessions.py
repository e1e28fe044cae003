"""Live sessions: keyed state that takes deltas in strict order.

A delta names the revision it expects; it is applied if that is the session's
current one and the next is one more, else rejected with the state unchanged.
There is no lateness allowance: order is by revision, not by time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id long, seq long, revision long, status string, n_keys int"
STATE = "revision long, data string"


def advance(revision: int, data: dict, delta: tuple, valid=None) -> tuple[int, dict, str]:
    """The state after one delta (expected, next, key, value) and what became of it. Keys in the delta replace; others stay.

    ``valid`` (key, value) judges the merged state; where it refuses, the merge is
    undone: the value from before comes back, or the key goes.
    """
    expected, following, key, value = delta
    if expected != revision or following != expected + 1:
        return revision, data, "InvalidRevision"
    had, previous = key in data, data.get(key)
    data[key] = value
    if valid and not valid(key, value):
        if had:
            data[key] = previous
        else:
            del data[key]
        return revision, data, "InvalidValue"
    return following, data, "applied"


def live_sessions(deltas: DataFrame, valid=None) -> DataFrame:
    """For each delta (session_id, seq, expected_revision, next_revision, key, value) its outcome and the session's revision and keys after it. ``deltas`` is a stream; ``valid`` (key, value) may refuse a delta. Deltas of one micro-batch are taken in the order of ``seq``; a session's keys are its state, so they must fit a task."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, text = state.get if state.exists else (0, "{}")
        data = json.loads(text)
        rows = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            revision, data, status = advance(revision, data, (row.expected_revision, row.next_revision, row.key, row.value), valid)
            rows.append((key[0], row.seq, revision, status, len(data)))
        state.update((revision, json.dumps(data, sort_keys=True)))
        yield pd.DataFrame(rows, columns=["session_id", "seq", "revision", "status", "n_keys"])

    columns = ["session_id", "seq", "expected_revision", "next_revision", "key", "value"]
    return deltas.select(*columns).groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def coalesced(deltas: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The last value of each key in each window of time: what is left of quick edits. Works on streams and tables."""
    stamped = deltas.withColumn("__at", F.col(time).cast("timestamp"))
    if deltas.isStreaming:
        stamped = stamped.withWatermark("__at", late)
    last = stamped.groupBy(F.window("__at", width), "session_id", "key").agg(F.max_by("value", F.struct("__at", "seq")).alias("value"), F.count(F.lit(1)).alias("n"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "session_id", "key", "value", "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream's rows to Parquet until its present input is used up."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
