"""The session state machine in batch form: running counters and gates as windows over ordered events.

Input rows: session, sec, event_id, event, tool, path. A segment is what lies between two ends of a
session. The order inside a session is (sec, event_id), and state never crosses sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GATE = 8
IDLE = 30 * 60
EDITS = ("Edit", "Write", "MultiEdit", "NotebookEdit")


def _order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("sec", "event_id")


def segments(events: DataFrame) -> DataFrame:
    """Adds ``segment``, the number of ends before the row in its session."""
    before = _order("session").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.when(F.col("event") == "SessionEnd", 1).otherwise(0)).over(before), F.lit(0))
    return events.withColumn("segment", ended.cast("long"))


def is_edit() -> Column:
    return (F.col("event") == "PostToolUse") & F.col("tool").isin(*EDITS)


def counted(events: DataFrame) -> DataFrame:
    """Adds ``changes`` so far in the segment, and ``at_stage``, the count when the last stage came."""
    sofar = _order("session", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = segments(events).withColumn("changes", F.sum(F.when(is_edit(), 1).otherwise(0)).over(sofar).cast("long"))
    return rows.withColumn("at_stage", F.last(F.when(F.col("event") == "stage", F.col("changes")), ignorenulls=True).over(sofar))


def stage_gate(events: DataFrame, gate: int = GATE) -> DataFrame:
    """Every Stop with whether a stage is due."""
    due = (F.col("changes") >= gate) & (F.col("at_stage").isNull() | (F.col("changes") - F.col("at_stage") >= gate))
    return counted(events).where("event = 'Stop'").select("session", "segment", "event_id", "changes", due.alias("due"))


def flushes(events: DataFrame, gate: int = GATE) -> DataFrame:
    """Every SessionEnd with its verdict: nothing staged, too few changes, or saved."""
    verdict = F.when(F.col("at_stage").isNull(), "nothing_staged").when(F.col("changes") < gate, "below_threshold").otherwise("saved")
    return counted(events).where("event = 'SessionEnd'").select("session", "segment", "event_id", "changes", verdict.alias("verdict"))


def files(events: DataFrame) -> DataFrame:
    """Paths of a segment in order of first touch."""
    first = F.min(F.struct("sec", "event_id")).alias("first")
    touched = segments(events).where("tool IS NOT NULL AND path <> ''").groupBy("session", "segment", "path").agg(first)
    order = Window.partitionBy("session", "segment").orderBy("first.sec", "first.event_id")
    return touched.select("session", "segment", "path", F.row_number().over(order).cast("long").alias("position"))


def orphans(events: DataFrame, idle: int = IDLE, gate: int = GATE) -> DataFrame:
    """Segments that were idle for ``idle`` seconds without an end, as of the last event of all: recovered or swept."""
    # one row: the clock of the whole log
    clock = F.broadcast(events.agg(F.max("sec").alias("clock")))
    last = counted(events).groupBy("session", "segment").agg(F.max("sec").alias("last"), F.max("changes").alias("changes"), F.max("at_stage").alias("at_stage"), F.bool_or(F.col("event") == "SessionEnd").alias("ended"))
    late = last.join(clock).where(~F.col("ended") & F.col("at_stage").isNotNull() & (F.col("clock") - F.col("last") >= idle))
    return late.select("session", "segment", F.when(F.col("changes") >= gate, "recovered").otherwise("swept").alias("verdict"))


def idle_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """R7 as event-time session windows over ``ts``."""
    grouped = events.groupBy("session", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("session", F.unix_seconds("w.start").alias("start"), "n")


def injected_once(candidates: DataFrame, cap: int = 3) -> DataFrame:
    """Per session, prompts in order (seq) take up to ``cap`` candidates (rank order) that the session has not had.

    The cap holds for each prompt, so repeats may not be dropped first: the fold runs over one session's
    prompts in order, in the JVM, on arrays no longer than a session's candidates.
    """
    one = F.struct("seq", F.col("ids").alias("ids"))
    prompts = candidates.groupBy("session", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    lists = prompts.groupBy("session").agg(F.array_sort(F.collect_list(one)).alias("ps"))
    start = F.struct(F.array().cast("array<string>").alias("had"), F.array().cast("array<struct<seq:bigint,id:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fresh = F.slice(F.array_except(p["ids"], acc["had"]), 1, cap)
        rows = F.transform(fresh, lambda i: F.struct(p["seq"].cast("bigint").alias("seq"), i.alias("id")))
        return F.struct(F.concat(acc["had"], fresh).alias("had"), F.concat(acc["out"], rows).alias("out"))

    return lists.select("session", F.explode(F.aggregate("ps", start, step, lambda a: a["out"])).alias("x")).select("session", "x.seq", "x.id")


FLOOR, PICKS = 0.3, 3


def relevance_pull(found: DataFrame, floor: float = FLOOR, cap: int = PICKS) -> DataFrame:
    """(session, seq, rank, id, overlap, passed, picked) of every candidate that a prompt looks at.

    ``found`` has session, seq, rank, id and overlap. A prompt goes through its candidates by rank,
    picks those at or over the floor that its session has not had, and stops after ``cap`` picks:
    what comes later is not looked at and not logged.
    """
    taken = injected_once(found.where(F.col("overlap") >= floor).select("session", "seq", "rank", "id"), cap)
    marked = found.join(taken.withColumn("picked", F.lit(True)), ["session", "seq", "id"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    ends = marked.where("picked").groupBy("session", "seq").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    seen = marked.join(ends, ["session", "seq"], "left").where(F.col("n").isNull() | (F.col("n") < cap) | (F.col("rank") <= F.col("last")))
    return seen.select("session", "seq", "rank", "id", "overlap", (F.col("overlap") >= floor).alias("passed"), "picked")
