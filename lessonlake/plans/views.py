"""Views over the driver's tables. Each has one SQL text; the few functions that differ by engine are named in ``_DIALECTS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations")
#: All age and review rules compare with this instant.
NOW = 1735689600

_KEPT = r"'[^0-9A-Za-z_\t\n\f\r -]'"
_BLANKS = r"'[\t\n\f\r ]+'"
_SPARK = {
    "div": "div",
    "epoch": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))",
    "fp": f"sha2(array_join(array_sort(split(trim(regexp_replace(regexp_replace(lower(BODY), r{_KEPT}, ''), r{_BLANKS}, ' ')), ' ')), ' '), 256)",
    "key": "get_json_object(props, '$.k')",
    "under": "replace(p_name, ' ', '_')",
}
_DUCK = {
    "div": "//",
    "epoch": "CAST(floor(epoch(ts)) AS BIGINT)",
    "fp": f"sha256(array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(BODY), {_KEPT}, '', 'g'), {_BLANKS}, ' ', 'g')), ' ')), ' '))",
    "key": "json_extract_string(props, '$.k')",
    "under": "replace(p_name, ' ', '_')",
}

_MEMORY = """
  SELECT concat('mem_', lpad(CAST(d.doc_id AS STRING), 10, '0')) AS id, d.doc_id,
         concat('sess_', CAST(d.doc_id % 50 AS STRING)) AS session_id, {task_type} AS task_type, {kind} AS kind,
         substr(d.text, 1, 60) AS title, substr(d.text, 61, {half}) AS what, substr(d.text, 61 + {half}) AS learned,
         concat(d.lang, ' ', d.source) AS tags,
         1704067200 + d.doc_id * 3600 AS created_at, 1704067200 + d.doc_id * 3600 AS updated_at,
         CASE WHEN d.doc_id % 3 = 0 THEN 'shared' ELSE 'personal' END AS scope,
         CASE WHEN (d.doc_id {div} 20) % 4 = 3 AND (d.doc_id {div} 80) % 2 = 0 THEN 'auto' ELSE 'manual' END AS origin,
         CAST(coalesce(x.n, 0) AS BIGINT) AS expand_count, x.last AS last_expanded_at,
         coalesce(l.quality = 1, FALSE) AS pinned,
         CASE WHEN l.toxic = 1 THEN 1704067200 + d.doc_id * 3600 + 2592000 END AS review_after
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT e.event_id % c.n AS doc_id, count(*) AS n, max({epoch}) AS last
             FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) c
             WHERE e.event_type IN ('view', 'click') GROUP BY e.event_id % c.n) x ON x.doc_id = d.doc_id
"""
#: A text is dealt out whole: 60 characters of title, then half of the rest to each of the other fields.
_MEMORY = _MEMORY.replace("{half}", "greatest(0, (length(d.text) - 59) {div} 2)")
_KIND = "CASE (d.doc_id {div} 20) % 4 WHEN 0 THEN 'error_resolution' WHEN 1 THEN 'task_pattern' WHEN 2 THEN 'user_rule' ELSE 'session_summary' END"



VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # every document, blank lessons included: the requests of the ingest pipeline
    "save_requests": ((), _MEMORY.replace("{task_type}", "d.source").replace("{kind}", _KIND)),
    "memories": (("save_requests",), "SELECT *, {fp} AS fingerprint FROM save_requests WHERE length(trim(learned)) > 0"),
    # copies always share lang, so this grouping makes them meet
    "memories_dd": (("memories",), "SELECT m.id, m.doc_id, substr(tags, 1, 2) AS task_type, 'task_pattern' AS kind, title, what, learned, tags, created_at FROM memories m"),
    "search_requests": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "prompts": ((), "SELECT conv_id AS session, turn AS seq, text AS query FROM conversations WHERE role = 'user'"),
    "symbols": ((), "SELECT p_partkey AS id, concat(p_brand, '.', {under}, '.', CAST(p_partkey AS STRING)) AS qname, {under} AS name, "
        "CASE p_size % 6 WHEN 0 THEN 'func' WHEN 1 THEN 'method' WHEN 2 THEN 'type' WHEN 3 THEN 'interface' WHEN 4 THEN 'const' ELSE 'var' END AS kind, "
        "p_brand AS package, p_type AS signature, p_partkey % 3 <> 0 AS exported, CAST(p_size AS BIGINT) AS line FROM part"),
    # three spellings of each name
    "spelled": (("symbols",), "SELECT id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE replace(name, '_', '-') END AS task_type FROM symbols"),
    "edges": ((), "SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee "
        "FROM lineitem) t WHERE callee IS NOT NULL AND caller <> callee"),
    "implements": (("symbols",), "SELECT i.id AS iface, t.id AS impl FROM symbols i JOIN symbols t ON i.signature = t.signature AND i.kind = 'interface' AND t.kind = 'type'"),
    "hook_events": ((), "SELECT user_id AS session, event_id, {epoch} AS sec, ts, "
        "CASE event_type WHEN 'click' THEN 'PostToolUse' WHEN 'view' THEN 'PostToolUse' WHEN 'purchase' THEN 'stage' WHEN 'error' THEN 'Stop' "
        "ELSE CASE WHEN event_id % 10 = 0 THEN 'SessionEnd' ELSE 'SessionStart' END END AS event, "
        "CASE event_type WHEN 'click' THEN 'Edit' WHEN 'view' THEN 'Read' END AS tool, concat('f', {key}) AS path FROM events"),
}


def _text(name: str, dialect: dict[str, str]) -> str:
    text = VIEWS[name][1]
    for key, value in dialect.items():
        text = text.replace("{" + key + "}", value.replace("BODY", "concat_ws(' ', task_type, kind, title, learned)"))
    return text


def needed(names: tuple[str, ...]) -> list[str]:
    """The views in ``names`` with those they read, in order."""
    out: list[str] = []
    for name in names:
        for n in [*needed(VIEWS[name][0]), name]:
            if n not in out:
                out.append(n)
    return out


def mentioned(sql: str) -> tuple[str, ...]:
    import re

    words = set(re.findall(r"\w+", sql))
    return tuple(v for v in VIEWS if v in words)


def cte(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL with the views it mentions in front; ``sql`` may itself begin with WITH."""
    views = ",\n".join(f"{v} AS ({_text(v, _DUCK)})" for v in needed(mentioned(sql)))
    sql = sql.strip()
    if not views:
        return sql
    word = "WITH RECURSIVE" if recursive or sql.upper().startswith("WITH RECURSIVE") else "WITH"
    for head in ("WITH RECURSIVE", "WITH"):
        if sql.upper().startswith(head):
            return f"{word} {views},\n{sql[len(head):].strip()}"
    return f"{word} {views}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    return run(spark, sf_dir, _text(name, _SPARK), VIEWS[name][0])


def run(spark: SparkSession, sf_dir: str, sql: str, views: tuple[str, ...] | None = None, **more: DataFrame) -> DataFrame:
    """Spark SQL over tables and views by name."""
    import re

    names = mentioned(sql) if views is None else views
    found = {v: view(spark, sf_dir, v) for v in names}
    words = set(re.findall(r"\w+", sql))
    found |= {t: table(spark, sf_dir, t) for t in TABLES if t in words}
    found |= more
    return with_frames(spark, sql, found)


def with_frames(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Spark SQL with DataFrames as tables; the temporary names are gone when this returns."""
    import re
    import uuid

    tag = uuid.uuid4().hex[:12]
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{name}_{tag}")
        sql = re.sub(rf"(?<=\bFROM )\s*{name}\b|(?<=\bJOIN )\s*{name}\b", f"{name}_{tag}", sql)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(f"{name}_{tag}")
