"""The session state machine as a stateful stream, and windows over events.

State is one row for each session: changes, count at the last stage (-1: none), segment. Rows of a
micro-batch come unordered and are sorted by (sec, event_id), so results equal the batch form's when
files arrive in order or in one trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lessonlake.operators.sessions import EDITS, GATE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_OUT = "session long, segment long, event_id long, event string, changes long, verdict string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events."""
    return spark.readStream.schema(EVENTS).parquet(path)


def _machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    changes, staged, segment = state.get if state.exists else (0, -1, 0)
    rows, out = pd.concat(list(batches)).sort_values(["sec", "event_id"]), []
    for r in rows.itertuples(index=False):
        if r.event == "PostToolUse" and r.tool in EDITS:
            changes += 1
        elif r.event == "stage":
            staged = changes
        elif r.event == "Stop":
            due = changes >= GATE and (staged < 0 or changes - staged >= GATE)
            out.append((key[0], segment, r.event_id, r.event, changes, "due" if due else "not_due"))
        elif r.event == "SessionEnd":
            verdict = "nothing_staged" if staged < 0 else "below_threshold" if changes < GATE else "saved"
            out.append((key[0], segment, r.event_id, r.event, changes, verdict))
            changes, staged, segment = 0, -1, segment + 1
    state.update((int(changes), int(staged), int(segment)))
    yield pd.DataFrame(out, columns=["session", "segment", "event_id", "event", "changes", "verdict"])


def machine(events: DataFrame) -> DataFrame:
    """A row for every Stop and SessionEnd, with the same verdicts as the batch form."""
    return events.groupBy("session").applyInPandasWithState(_machine, _OUT, "changes long, staged long, segment long", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts by type and window; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")
