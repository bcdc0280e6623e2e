"""Session, redaction and event-time queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlake.operators import scrub as P
from lessonlake.operators import sessions as E
from lessonlake.plans.catalog import run
from lessonlake.plans.registry import register
from lessonlake.plans.views import _SPARK, VIEWS, cte, table, view
from lessonlake.sources import hooks as H
from lessonlake.sources.shared import shared_path
from lessonlake.streaming import sessions as stream


def on(name, view_name, build, oracle=None):
    register(name, lambda spark, sf_dir: build(view(spark, sf_dir, view_name)), cte(oracle) if oracle else None)


_SEG = """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event = 'SessionEnd' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM hook_events),
c AS (SELECT *, sum(CASE WHEN event = 'PostToolUse' AND tool = 'Edit' THEN 1 ELSE 0 END) OVER w::BIGINT AS changes FROM s WINDOW w AS (PARTITION BY session, segment ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, last_value(CASE WHEN event = 'stage' THEN changes END IGNORE NULLS) OVER (PARTITION BY session, segment ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_stage FROM c) """
_DUE = "changes >= 8 AND (at_stage IS NULL OR changes - at_stage >= 8)"
_VERDICT = "CASE WHEN at_stage IS NULL THEN 'nothing_staged' WHEN changes < 8 THEN 'below_threshold' ELSE 'saved' END"
on("r2_change_counter", "hook_events", lambda h: E.counted(h).select("session", "segment", "event_id", "changes"), _SEG + "SELECT session, segment, event_id, changes FROM k")
on("r3_stage", "hook_events", lambda h: E.counted(h).where("event = 'stage'").select("session", "event_id", F.col("at_stage").alias("at_stage")), _SEG + "SELECT session, event_id, at_stage FROM k WHERE event = 'stage'")
on("r4_stage_gate", "hook_events", E.stage_gate, _SEG + f"SELECT session, segment, event_id, changes, {_DUE} AS due FROM k WHERE event = 'Stop'")
on("r5_flush_gate", "hook_events", E.flushes, _SEG + f"SELECT session, segment, event_id, changes, {_VERDICT} AS verdict FROM k WHERE event = 'SessionEnd'")
on("r6_segments", "hook_events", lambda h: E.segments(h).groupBy("session", "segment").agg(F.count(F.lit(1)).alias("n")), _SEG + "SELECT session, segment, count(*) AS n FROM k GROUP BY session, segment")
on("r7_orphans", "hook_events", E.orphans, _SEG + "SELECT session, segment, CASE WHEN max(changes) >= 8 THEN 'recovered' ELSE 'swept' END AS verdict FROM k GROUP BY session, segment HAVING NOT bool_or(event = 'SessionEnd') AND max(at_stage) IS NOT NULL AND (SELECT max(sec) FROM hook_events) - max(sec) >= 1800")
on("r7_idle_windows", "hook_events", lambda h: E.idle_windows(h), "WITH g AS (SELECT session, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts >= lag(ts) OVER o + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM hook_events WINDOW o AS (PARTITION BY session ORDER BY ts)), n AS (SELECT session, ts, sum(fresh) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS w FROM g) SELECT session, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM n GROUP BY session, w")
on("r9_files", "hook_events", E.files, _SEG + ", f AS (SELECT session, segment, path, min((sec, event_id)) AS first FROM k WHERE tool IS NOT NULL AND path <> '' GROUP BY session, segment, path) SELECT session, segment, path, row_number() OVER (PARTITION BY session, segment ORDER BY first) AS position FROM f")


def _hook_lines(h):
    """The hook events as JSON lines: some are broken, some have fields of other types, some Stops are active already."""
    told = F.to_json(F.struct(F.concat(F.substring("event", 1, 4), F.lit("-"), F.substring("event", 5, 20)).alias("hook_event_name"), F.col("session").cast("string").alias("session_id"), F.col("tool").alias("tool_name"), F.struct(F.when(F.col("event_id") % 2 == 0, F.col("path")).alias("file_path"), F.when(F.col("event_id") % 2 == 1, F.col("path")).alias("notebook_path")).alias("tool_input"), (F.col("event_id") % 5 == 0).alias("stop_hook_active"), F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("hi")).alias("prompt")))
    value = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).when(F.col("event_id") % 13 == 0, F.lit("[1]")).otherwise(told)
    return h.select("event_id", value.alias("value"))


_BROKEN = "(event_id % 11 = 0 OR event_id % 13 = 0)"
_NAME = f"CASE WHEN {_BROKEN} THEN '' ELSE lower(event) END"
_HANDLED = f"NOT {_BROKEN} AND event IN ('PostToolUse', 'Stop', 'SessionEnd', 'SessionStart') AND NOT (event = 'Stop' AND event_id % 5 = 0)"
on("s14_hook_events", "hook_events", lambda h: H.parse(_hook_lines(h)).select("event_id", "event", "tool", "path", "handled"),
   f"SELECT event_id, {_NAME} AS event, CASE WHEN NOT {_BROKEN} THEN tool END AS tool, CASE WHEN NOT {_BROKEN} AND tool IN ('Edit', 'Read') THEN nullif(path, '') END AS path, {_HANDLED} AS handled FROM hook_events")
on("r1_dispatch", "hook_events", lambda h: H.dispatch_counts(H.parse(_hook_lines(h))), f"SELECT session::STRING AS session, lower(event) AS event, count(*) AS n FROM hook_events WHERE {_HANDLED} GROUP BY ALL")


def r1_stream_machine(spark, sf_dir):
    """The stream over the whole events table in one trigger, as a table."""
    found = stream.read_events(spark, sf_dir + "/events.parquet*")
    hooks = run(spark, sf_dir, VIEWS["hook_events"][1].replace("{epoch}", _SPARK["epoch"]).replace("{key}", _SPARK["key"]), (), events=found)
    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    query = stream.machine(hooks.drop("ts")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


register("r1_stream_machine", r1_stream_machine, cte(_SEG + f"SELECT session, segment, event_id, event, changes, CASE WHEN event = 'Stop' THEN CASE WHEN {_DUE} THEN 'due' ELSE 'not_due' END ELSE {_VERDICT} END AS verdict FROM k WHERE event IN ('Stop', 'SessionEnd')"))
register("x_tumbling_windows", lambda spark, sf_dir: stream.tumbling(table(spark, sf_dir, "events")), "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")


# ---- redaction ---------------------------------------------------------------------------------
def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


register("p1_scrub", lambda s, d: P.scrub(_docs(s, d), "text").select("doc_id", "text", "redactions"))
_EXACT = [n for x in P.DETECTORS if not x.any_case for n in x.needles]
_FOLDED = [n for x in P.DETECTORS if x.any_case for n in x.needles]
register("p2_prefilter", lambda s, d: _docs(s, d).select("doc_id", P.may_match(F.col("text")).alias("candidate")), "SELECT doc_id, coalesce(" + " OR ".join([f"contains(text, '{n}')" for n in _EXACT] + [f"contains(lower(text), '{n}')" for n in _FOLDED] + ["strlen(text) <> length(text)"]) + ", FALSE) AS candidate FROM documents")
register("s13_scrub_file", lambda s, d: P.by_pattern(P.scrub(_docs(s, d), "text")))
register("a4_scrub_stats", lambda s, d: P.stats(P.scrub(_docs(s, d), "text")))
# planted: a key among the tags, an address as the session
_KEY = "concat('AK', 'IA', 'ABCDEFGHIJKLMNOP')"
_TAGS = f"CASE WHEN doc_id % 7 = 0 THEN concat(tags, ' ', {_KEY}, ' more') ELSE tags END"
_SESSION = "CASE WHEN doc_id % 9 = 0 THEN concat('u', CAST(doc_id AS STRING), '@example.org') ELSE session_id END"
on("i3_tag_secrets", "memories", lambda m: P.offenders(m.select("id", F.expr(_TAGS).alias("tags")), "tags", "id"), f"SELECT id, {_KEY} AS offender FROM memories WHERE doc_id % 7 = 0")
on("i4_identifier_secrets", "memories", lambda m: P.scrub_fields(m.select("id", F.expr(_SESSION).alias("session_id"), "task_type", F.expr(_TAGS).alias("tags")), ("session_id", "task_type", "tags")).select("id", P.secret_field(("session_id", "task_type", "tags")).alias("error")),
   "SELECT id, CASE WHEN doc_id % 9 = 0 THEN 'session_id_contains_secret' WHEN doc_id % 7 = 0 THEN 'tags_contains_secret' END AS error FROM memories")
on("i14_rescrub", "memories", lambda m: P.rescrub(m).select("id", "fingerprint", F.size("fields_redacted").cast("long").alias("fields")))
register("s11_repo_stamp", lambda s, d: s.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(d).select("length", F.unix_seconds("modificationTime").alias("at")).agg(F.concat_ws(":", F.lit("v1"), F.count(F.lit(1)).cast("string"), F.sum("length").cast("string"), F.max("at").cast("string")).alias("stamp")))
