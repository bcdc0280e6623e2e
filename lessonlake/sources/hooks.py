"""Hook events from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.functions import text as T

_SCHEMA = "hook_event_name string, session_id string, prompt string, tool_name string, tool_input struct<file_path: string, notebook_path: string>, stop_hook_active boolean"
EVENTS = ("posttooluse", "stop", "sessionend", "sessionstart", "userpromptsubmit")


def parse(lines: DataFrame) -> DataFrame:
    """Event, session, tool, path, prompt, active and ``handled`` of every line (column value).

    A line that is no JSON object, or whose fields have other types, is an event without a name:
    nothing fails. An event is handled if its name is known, it has a session where one is needed, a
    Stop is not already active, and a prompt is not blank.
    """
    r = F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("r", r)
    event = T.event_name(F.coalesce("r.hook_event_name", F.lit("")))
    session = F.coalesce("r.session_id", F.lit(""))
    path = T.hook_path(F.col("r.tool_name"), F.col("r.tool_input.file_path"), F.col("r.tool_input.notebook_path"))
    active = F.coalesce("r.stop_hook_active", F.lit(False))
    fine = event.isin(*EVENTS) & ((event == "sessionstart") | (session != "")) & ~((event == "stop") & active)
    fine = fine & ~((event == "userpromptsubmit") & (T.trimmed(F.coalesce("r.prompt", F.lit(""))) == ""))
    columns = [event.alias("event"), session.alias("session"), F.col("r.tool_name").alias("tool"), path.alias("path"), F.col("r.prompt").alias("prompt"), active.alias("active"), fine.alias("handled")]
    return rows.select(*[c for c in lines.columns if c != "value"], *columns)


def dispatch_counts(events: DataFrame) -> DataFrame:
    """(session, event, n) of handled events."""
    return events.where("handled").groupBy("session", "event").agg(F.count(F.lit(1)).alias("n"))
