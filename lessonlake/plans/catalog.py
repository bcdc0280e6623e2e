"""Queries over functions, lookups, joins, censuses, ranking, context and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lessonlake.functions import text as T
from lessonlake.operators import graph as G
from lessonlake.operators import retrieval as R
from lessonlake.operators import store as S
from lessonlake.plans.registry import register
from lessonlake.plans.retrieval_queries import _MEM_INDEX, _REQ, _bm25_sql, _jac, _phrase_sql, _search_tail, _tokens_sql
from lessonlake.plans.views import NOW, cte, run, table, view


def on(name: str, view_name: str, build, oracle: str) -> None:
    """A DataFrame query over one view."""
    register(name, lambda spark, sf_dir: build(view(spark, sf_dir, view_name)), cte(oracle))


# ---- functions -------------------------------------------------------------------------------
_BLANK, _NOT = r"'[\t\n\f\r ]+'", r"'[^0-9A-Za-z_\t\n\f\r -]'"
_WORDS = "list_filter(string_split(regexp_replace(regexp_replace(lower({x}), " + _NOT + ", '{by}', 'g'), " + _BLANK + ", ' ', 'g'), ' '), lambda x: x <> '')"


def _w(x: str, by: str) -> str:
    return _WORDS.replace("{x}", x).replace("{by}", by)


def _joined(terms):
    return F.array_join(terms, " ")


def _ordered_sql(x: str, by: str) -> str:
    """Distinct long words in order of first occurrence."""
    words = f"list_filter({_w(x, by)}, lambda x: strlen(x) > 2)"
    return f"(SELECT array_to_string(list_transform(list_sort(list_transform(list_distinct(ws), lambda t: {{'p': list_position(ws, t), 't': t}})), lambda y: y.t), ' ') FROM (SELECT {words} AS ws))"


on("f1_normalize", "memories", lambda m: m.select("id", T.normalized(F.concat_ws(" ", "task_type", "kind", "title", "learned")).alias("normal")),
   f"SELECT id, array_to_string(list_sort({_w('concat_ws(\' \', task_type, kind, title, learned)', '')}), ' ') AS normal FROM memories")
on("f2_fingerprint", "memories", lambda m: m.select("id", T.fingerprint(*[F.col(c) for c in ("task_type", "kind", "title", "learned")]).alias("fingerprint")), "SELECT id, fingerprint FROM memories")
on("f3_token_set", "memories", lambda m: m.select("id", _joined(F.array_sort(T.tokens(F.col("learned")))).alias("tokens")),
   f"SELECT id, array_to_string(list_sort({_tokens_sql('learned')}), ' ') AS tokens FROM memories")
on("f4_dedupe_tokens", "memories", lambda m: m.select("id", _joined(T.tokens(F.col("what"))).alias("tokens")), f"SELECT id, {_ordered_sql('what', ' ')} AS tokens FROM memories")
on("f5_search_terms", "memories", lambda m: m.select("id", _joined(T.search_terms(F.col("what"))).alias("terms")), f"SELECT id, {_ordered_sql('what', '')} AS terms FROM memories")
on("f6_term_cap", "memories", lambda m: m.select("id", _joined(F.array_sort(T.capped(T.tokens(F.col("what")), 20))).alias("terms")),
   f"SELECT id, array_to_string(list_sort(list_transform(list_slice(list_sort(list_transform({_tokens_sql('what')}, lambda x: {{'n': -strlen(x), 't': x}})), 1, 20), lambda x: x.t)), ' ') AS terms FROM memories")
_PAIR = "FROM memories a JOIN memories b ON b.doc_id = a.doc_id + 20"


def f7_jaccard(spark, sf_dir):
    m = view(spark, sf_dir, "memories")
    a, b = m.select("doc_id", "id", T.tokens(R.body()).alias("x")), m.select((F.col("doc_id") - 20).alias("doc_id"), T.tokens(R.body()).alias("y"))
    return a.join(b, "doc_id").select("id", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


_BODY = "concat_ws(' ', {0}.title, {0}.what, {0}.learned, {0}.tags)"
_AB = f"WITH t AS (SELECT a.id, {_tokens_sql(_BODY.format('a'))} AS x, {_tokens_sql(_BODY.format('b'))} AS y {_PAIR}) "
register("f7_f8_jaccard_overlap", f7_jaccard, cte(_AB + f"SELECT id, round({_jac('x', 'y')}, 6) AS jaccard, round(CASE WHEN len(x) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(x) END, 6) AS overlap FROM t"))
on("f9_phrases", "search_requests", lambda r: r.select("query_id", F.posexplode(T.phrases(F.col("query"))).alias("position", "phrase")),
   rf"SELECT query_id, (unnest(range(len(ps))))::INTEGER AS position, unnest(ps) AS phrase FROM (SELECT query_id, list_filter(regexp_split_to_array(query, {_BLANK}), lambda x: x <> '') AS ps FROM search_requests) t")
on("f10_symbol_terms", "symbols", lambda s: s.select("id", _joined(T.symbol_terms(F.col("qname"))).alias("terms")),
   r"SELECT id, array_to_string(list_filter(regexp_split_to_array(qname, '[^\p{L}\p{Nd}_]+'), lambda x: strlen(x) >= 2), ' ') AS terms FROM symbols")
on("f12_snippet", "memories", lambda m: m.select("id", T.snippet(F.col("what")).alias("snippet")), rf"""
WITH flat AS (SELECT id, trim(regexp_replace(what, {_BLANK}, ' ', 'g')) AS t FROM memories),
cuts AS (SELECT id, t, substr(t, 1, 120) AS c FROM flat),
heads AS (SELECT *, CASE WHEN contains(c, ' ') THEN substr(c, 1, length(c) - length(list_extract(string_split(c, ' '), -1)) - 1) END AS h FROM cuts)
SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE concat(CASE WHEN coalesce(strlen(h), -1) > 60 THEN h ELSE c END, '…') END AS snippet FROM heads""")
on("f13_needs_review", "memories", lambda m: m.select("id", T.needs_review(F.col("review_after"), NOW).alias("needs_review")), f"SELECT id, coalesce(review_after < {NOW}, FALSE) AS needs_review FROM memories")
on("f14_slug", "symbols", lambda s: s.select("id", T.slug(F.col("name")).alias("slug")), "SELECT id, replace(lower(name), '_', '-') AS slug FROM symbols")
on("f15_task_type_gate", "symbols", lambda s: s.select("id", T.valid_task_type(F.col("name")).alias("valid"), T.valid_task_type(F.col("signature")).alias("valid_signature")),
   r"SELECT id, regexp_full_match(lower(trim(name)), '[a-z0-9][a-z0-9._-]*') AND strlen(trim(name)) <= 64 AS valid, regexp_full_match(lower(trim(signature)), '[a-z0-9][a-z0-9._-]*') AND strlen(trim(signature)) <= 64 AS valid_signature FROM symbols")
on("f16_field_caps", "memories", lambda m: m.withColumn("title", F.substring("what", 1, 190)).select("id", T.over_cap().alias("over")),
   "SELECT id, CASE WHEN strlen(task_type) > 64 THEN 'task_type' WHEN strlen(session_id) > 64 THEN 'session_id' WHEN strlen(substr(what, 1, 190)) > 200 THEN 'title' WHEN strlen(what) > 8192 THEN 'what' WHEN strlen(learned) > 4096 THEN 'learned' WHEN strlen(tags) > 500 THEN 'tags' END AS over FROM memories")
_EMPTY_IN = "CASE WHEN doc_id % 3 = 0 THEN '[EMAIL] [SECRET]' ELSE title END"
on("f17_empty_after_scrub", "memories", lambda m: m.select("id", T.empty_after_scrub(F.expr(_EMPTY_IN)).alias("emptied")),
   rf"SELECT id, trim(regexp_replace(regexp_replace({_EMPTY_IN}, '\[[A-Z_]+\]', '', 'g'), {_BLANK}, ' ', 'g')) = '' AS emptied FROM memories")
on("f18_entropy", "memories", lambda m: m.select("id", F.round(T.entropy(F.col("title")), 6).alias("bits")),
   "WITH c AS (SELECT id, ch, count(*) AS k FROM (SELECT id, unnest(list_filter(string_split(title, ''), lambda x: x <> '')) AS ch FROM memories) t GROUP BY id, ch), n AS (SELECT id, sum(k) AS n FROM c GROUP BY id) SELECT id, round(-sum(k::DOUBLE / n * log2(k::DOUBLE / n)), 6) AS bits FROM c JOIN n USING (id) GROUP BY id")
_IP = "concat_ws('.', CAST(id % 300 AS STRING), CAST(line AS STRING), CAST(id % 7 AS STRING), CAST(line % 256 AS STRING))"
on("f19_ipv4", "symbols", lambda s: s.select("id", T.valid_ipv4(F.expr(_IP)).alias("valid")), "SELECT id, id % 300 <= 255 AND line <= 255 AS valid FROM symbols")
on("f20_minted_ids", "memories", lambda m: m.select("id", T.minted("mem_", F.col("fingerprint"), F.col("created_at").cast("string")).alias("minted")), "SELECT id, concat('mem_', substr(sha256(concat_ws('|', fingerprint, created_at::STRING)), 1, 26)) AS minted FROM memories")
on("f21_event_name", "hook_events", lambda h: h.select("event_id", T.event_name(F.concat(F.col("event"), F.lit("-_X"))).alias("name")), "SELECT event_id, concat(lower(event), 'x') AS name FROM hook_events")
on("f22_hook_path", "hook_events", lambda h: h.select("event_id", T.hook_path(F.col("tool"), F.col("path"), F.lit(None).cast("string")).alias("path")), "SELECT event_id, CASE WHEN tool IN ('Read', 'Edit', 'Write', 'MultiEdit', 'NotebookEdit') THEN nullif(path, '') END AS path FROM hook_events")
on("f23_safe_session", "memories", lambda m: m.select("id", T.safe_session(F.when(F.col("doc_id") % 2 == 0, F.col("session_id")).otherwise(F.col("title"))).alias("session")),
   "SELECT id, CASE WHEN regexp_full_match(trim(s), '[A-Za-z0-9_-]{1,128}') THEN trim(s) END AS session FROM (SELECT id, CASE WHEN doc_id % 2 = 0 THEN session_id ELSE title END AS s FROM memories) t")
on("f24_f26_symbol_names", "symbols", lambda s: s.select("id", T.short_package(F.concat(F.lit("mod/"), F.col("package")), "mod").alias("package"), T.last_name(F.col("qname")).alias("last"), T.is_exported(F.col("package")).alias("exported")),
   "SELECT id, package, id::STRING AS last, TRUE AS exported FROM symbols")
on("f25_lines", "memories", lambda m: m.select("id", T.first_line(F.col("what")).alias("line"), F.trim(F.regexp_replace("what", T.BLANK, " ")).alias("flat"), T.truncated(F.col("learned"), 300).alias("kept")),
   rf"SELECT id, trim(list_extract(string_split(ltrim(what), chr(10)), 1)) AS line, trim(regexp_replace(what, {_BLANK}, ' ', 'g')) AS flat, CASE WHEN strlen(learned) > 300 THEN concat(substr(learned, 1, list_max(list_filter(range(75, 301), lambda i: strlen(substr(learned, 1, i)) <= 300))), '…[truncated]') ELSE learned END AS kept FROM memories")
on("f28_limit_clamp", "symbols", lambda s: s.select("id", T.clamp(F.col("line") - 10, 5, 20).cast("long").alias("clamped")), "SELECT id, least(CASE WHEN line - 10 <= 0 THEN 5 ELSE line - 10 END, 20)::BIGINT AS clamped FROM symbols")
on("f29_type_label", "hook_events", lambda h: h.select("event_id", T.type_label(F.coalesce("tool", F.lit(" "))).alias("label")), "SELECT event_id, coalesce(nullif(trim(tool), ''), 'untyped') AS label FROM hook_events")
on("f30_growth_warnings", "memories", lambda m: m.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).select("task_type", _joined(T.growth_warnings(F.col("n") * 1000000, F.col("n") * 200)).alias("warnings")),
   "SELECT task_type, concat_ws(' ', CASE WHEN count(*) * 1000000 > 20971520 THEN 'size' END, CASE WHEN count(*) * 200 > 8000 THEN 'rows' END) AS warnings FROM memories GROUP BY task_type")

# ---- scans, lookups, sinks -------------------------------------------------------------------
on("s1_list", "memories", lambda m: S.list_memories(m, kind="task_pattern", scope="shared", limit=50).select("id", "task_type", "created_at"), "SELECT id, task_type, created_at FROM memories WHERE kind = 'task_pattern' AND scope = 'shared' ORDER BY created_at DESC, id DESC LIMIT 50")
on("s2_recent_sessions", "memories", lambda m: S.recent_sessions(m, 100).select("id", "title", "created_at"), "SELECT id, title, created_at FROM memories WHERE origin = 'auto' ORDER BY created_at DESC, id DESC LIMIT 100")
on("s3_lookup", "memories", lambda m: S.lookup(m, m.where("doc_id % 7 = 0").select("id")).select("id", "title", "last_expanded_at", "review_after"), "SELECT id, title, last_expanded_at, review_after FROM memories WHERE doc_id % 7 = 0")
on("s4_counting_lookup", "memories", lambda m: S.expand(m, m.where("doc_id % 7 = 0").select("id", F.lit(NOW).alias("at"))).where("doc_id % 7 = 0").select("id", "expand_count", "last_expanded_at"), f"SELECT id, expand_count + 1 AS expand_count, {NOW}::BIGINT AS last_expanded_at FROM memories WHERE doc_id % 7 = 0")
on("s6_export_shared", "memories", lambda m: S.export_shared(m), "SELECT fingerprint, to_json({'kind': kind, 'task_type': task_type, 'title': title, 'what': what, 'learned': learned, 'tags': tags})::STRING AS value FROM memories WHERE scope = 'shared'")


def s7_import_shared(spark, sf_dir):
    from lessonlake.sources.pool import verdicts

    lines = S.export_shared(view(spark, sf_dir, "memories")).select(F.col("value"))
    broken = lines.select(F.expr("CASE WHEN length(value) % 10 = 0 THEN substr(value, 2) WHEN length(value) % 10 = 1 THEN '  ' ELSE value END").alias("value"))
    return verdicts(broken, view(spark, sf_dir, "memories").where("doc_id % 6 = 0")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


register("s7_import_shared", s7_import_shared, cte("""WITH told AS (SELECT *, length(to_json({'kind': kind, 'task_type': task_type, 'title': title, 'what': what, 'learned': learned, 'tags': tags})::STRING) % 10 AS r FROM memories WHERE scope = 'shared'),
lines AS (SELECT * REPLACE (CASE WHEN r <> 1 AND (strlen(title) > 200 OR strlen(what) > 8192 OR strlen(learned) > 4096 OR trim(title) = '' OR trim(what) = '') THEN 0 ELSE r END AS r) FROM told),
seen AS (SELECT fingerprint FROM memories WHERE doc_id % 6 = 0),
v AS (SELECT r, CASE WHEN r = 0 THEN 'failed' WHEN fingerprint IN (SELECT fingerprint FROM seen) THEN 'skipped'
  WHEN row_number() OVER (PARTITION BY fingerprint, r = 0 ORDER BY id) > 1 THEN 'skipped' ELSE 'imported' END AS verdict FROM lines WHERE r <> 1)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict"""))
on("s9_record_files", "hook_events", lambda h: S.record_files(h.where("event_id % 2 = 0").select(F.col("session").cast("string").alias("session_id"), F.col("path").alias("file_path")).distinct(), h.where("event_id % 2 = 1").select(F.concat(F.lit(" "), F.col("session").cast("string")).alias("session_id"), F.col("path").alias("file_path"), F.col("sec").alias("created_at"))),
   "SELECT session::STRING AS session_id, path AS file_path, min(sec) AS created_at FROM hook_events h WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM hook_events o WHERE o.event_id % 2 = 0 AND o.session = h.session AND o.path = h.path) AND path <> '' GROUP BY session, path")
on("s15_tabular", "symbols", lambda s: S.tabular(s, "package", "symbols", ["id", "name", "signature"], ["id"]),
   "SELECT package, concat('symbols[', count(*), ']{id,name,signature}:', chr(10), string_agg(concat_ws(',', id::STRING, name, signature), chr(10) ORDER BY id)) AS text FROM symbols GROUP BY package")

# ---- joins -----------------------------------------------------------------------------------

# ---- aggregation -----------------------------------------------------------------------------
on("a1_kind_counts", "memories", S.kind_counts, "SELECT kind, count(*) AS n FROM memories GROUP BY kind UNION ALL SELECT 'total', count(*) FROM memories")
on("a2_task_census", "memories", S.census,
   "SELECT task_type, count(*) AS n, coalesce(max_by(title, created_at) FILTER (kind = 'session_summary'), '') AS newest FROM memories GROUP BY task_type")
on("a3_shared_count", "memories", S.shared_count, "SELECT count(*) AS n FROM memories WHERE scope = 'shared'")
on("a5_slug_near_miss", "spelled", S.slug_near_misses, """
WITH c AS (SELECT task_type, count(*) AS n, replace(lower(task_type), '_', '-') AS slug FROM spelled GROUP BY task_type)
SELECT task_type, n, (SELECT o.task_type FROM c o WHERE o.slug = c.slug AND o.task_type <> c.task_type ORDER BY o.n DESC, o.task_type LIMIT 1) AS other FROM c""")
register("a6_expand_signal", lambda spark, sf_dir: view(spark, sf_dir, "memories").select("id", "doc_id").join(S.expand_signal(view(spark, sf_dir, "hook_events")), "doc_id").drop("doc_id"),
         cte("SELECT m.id, count(*) AS n, max(h.sec) AS last FROM memories m JOIN hook_events h ON h.event_id = m.doc_id WHERE h.event = 'PostToolUse' GROUP BY m.id"))
on("a9_dashboard", "memories", S.dashboard, """SELECT 'kind' AS part, kind AS name, count(*) AS n, '' AS newest FROM memories GROUP BY kind
UNION ALL SELECT 'task_type', task_type, count(*), coalesce(max_by(title, created_at) FILTER (kind = 'session_summary'), '') FROM memories GROUP BY task_type
UNION ALL SELECT 'recent', title, created_at, '' FROM (SELECT * FROM memories WHERE origin = 'auto' ORDER BY created_at DESC, id DESC LIMIT 10) r""")
on("a13_row_count", "memories", S.row_count, "SELECT count(*) AS rows, count(DISTINCT task_type) AS task_types, sum(strlen(title) + strlen(what) + strlen(learned) + strlen(tags))::BIGINT AS bytes FROM memories")
on("j6_anti_keep_set", "memories", lambda m: S.outside_newest(m, 10).select("id"), "SELECT id FROM memories QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) > 10")
on("j7_semi_newest", "memories", lambda m: S.among_newest(m, 40).select("id", "title"), "SELECT id, title FROM memories ORDER BY created_at DESC, id DESC LIMIT 40")
on("j10_prefix_probe", "symbols", lambda s: G.with_methods(s.where("kind = 'type'").select("id", F.concat_ws(".", "package", F.substring("name", 1, 3)).alias("qname")), s.where("kind = 'method'").select(F.concat_ws(".", "package", F.substring("name", 1, 3), "name").alias("qname"))).select("id"),
   "SELECT t.id FROM symbols t WHERE t.kind = 'type' AND EXISTS (SELECT 1 FROM symbols m WHERE m.kind = 'method' AND m.package = t.package AND substr(m.name, 1, 3) = substr(t.name, 1, 3))")
on("j1_index_row", "memories", lambda m: S.index_rows(m, R.build(m).stats), f"WITH {_MEM_INDEX} SELECT id, d FROM stats")
on("f27_age_cutoff", "memories", lambda m: m.where(T.older(F.col("created_at"), NOW, 300)).select("id"), f"SELECT id FROM memories WHERE created_at < {NOW} - 300 * 86400")
on("s5_title_lookup", "memories", lambda m: S.by_title(m, m.select("id", "title")), "SELECT a.id, b.id AS found FROM memories a JOIN memories b ON a.title = b.title WHERE trim(a.title) <> ''")
on("s8_session_files", "hook_events", S.session_files, "SELECT session::STRING AS session_id, path AS file_path, min(sec) AS created_at FROM hook_events WHERE tool = 'Edit' GROUP BY session, path")


def a12_retrieval_metrics(spark, sf_dir):
    m = view(spark, sf_dir, "memories")
    targets = m.select("doc_id", F.col("id").alias("target"), F.array_join(F.slice(F.filter(F.split("title", " "), lambda w: w != ""), 2, 4), " ").alias("query"), F.col("kind").alias("class"))
    requests = targets.select(F.col("doc_id").alias("query_id"), "query")
    found = R.pull(requests, m, R.build(m), limit=20)
    ranks = targets.join(found.select(F.col("query_id").alias("doc_id"), F.col("id").alias("target"), "rank"), ["doc_id", "target"], "left")
    share = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("double")), 6)
    return ranks.rollup("class").agg(F.count(F.lit(1)).alias("n"), share(1).alias("recall_1"), share(5).alias("recall_5"), share(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")).withColumn("class", F.coalesce("class", F.lit("overall")))


register("a12_retrieval_metrics", a12_retrieval_metrics, cte(f"""WITH {_MEM_INDEX}, req AS (SELECT doc_id AS query_id, array_to_string(list_filter(string_split(title, ' '), lambda x: x <> '')[2:5], ' ') AS query FROM memories), {_phrase_sql('req', 'query')}, {_bm25_sql(R.FLAT)},
found AS ({_search_tail(20, 60).format(where='').replace("ranked AS (", "WITH ranked AS (", 1)}),
ranks AS (SELECT m.kind AS class, f.rank FROM memories m LEFT JOIN found f ON f.query_id = m.doc_id AND f.id = m.id),
every AS (SELECT * FROM ranks UNION ALL SELECT 'overall', rank FROM ranks)
SELECT class, count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM every GROUP BY class"""))

# ---- ranking, retention, context -------------------------------------------------------------
on("w1_manual_retention", "memories", lambda m: S.keep_manual(m).select("id", "task_type"), "SELECT id, task_type FROM memories WHERE kind = 'session_summary' AND origin = 'manual' QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) <= 5")
on("w2_auto_retention", "memories", lambda m: S.keep_auto(m).select("id", "expand_count"), "WITH a AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) <= 5 AS grace FROM memories WHERE kind = 'session_summary' AND origin = 'auto') SELECT id, expand_count FROM a ORDER BY grace DESC, expand_count > 0 DESC, last_expanded_at DESC NULLS LAST, created_at DESC, id DESC LIMIT 30")
on("w3_last_session", "memories", lambda m: S.last_session(m).select("task_type", "id", "title"), "SELECT task_type, id, title FROM memories WHERE kind = 'session_summary' QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) = 1")
on("w4_user_rules", "memories", lambda m: S.user_rules(m).select("task_type", "id", "position", "total", "tier", "learned"), "SELECT task_type, id, p AS position, total, CASE WHEN p <= 5 THEN 'always' ELSE 'browse' END AS tier, CASE WHEN p <= 5 THEN learned END AS learned FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) AS p, count(*) OVER (PARTITION BY task_type) AS total FROM memories WHERE kind = 'user_rule') t")


def _bundle(mode):
    def query(spark, sf_dir):
        m = view(spark, sf_dir, "memories")
        requests = view(spark, sf_dir, "search_requests").withColumn("task_type", F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string")))
        return S.context_bundle(requests, m, R.build(m), mode)

    return query


def _bundle_sql(mode: str) -> str:
    most, whole, full = S.MODES[mode]
    key = "key AS (SELECT query_id, query, concat('src', (query_id % 20)::STRING) AS task_type FROM search_requests)"
    always = "TRUE" if full < 0 else f"p <= {full}"
    parts = f"""SELECT query_id, 'session' AS section, 1::BIGINT AS position, id, learned AS text FROM (SELECT * FROM memories WHERE kind = 'session_summary' QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) = 1) s JOIN key USING (task_type)
UNION ALL SELECT query_id, CASE WHEN {always} THEN 'rule_always' ELSE 'rule_browse' END, p, id, CASE WHEN {always} THEN learned ELSE title END FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, id DESC) AS p FROM memories WHERE kind = 'user_rule') r JOIN key USING (task_type)"""
    if not most:
        return cte(f"WITH {key} {parts}")
    text = "concat_ws(chr(10), what, learned)" if whole else "snippet"
    return cte(rf"""WITH {_MEM_INDEX}, {_REQ}, {key}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.WEIGHTED)},
flat AS (SELECT id, trim(regexp_replace(what, {_BLANK}, ' ', 'g')) AS t FROM memories),
heads AS (SELECT id, t, substr(t, 1, 120) AS c, substr(substr(t, 1, 120), 1, length(substr(t, 1, 120)) - length(list_extract(string_split(substr(t, 1, 120), ' '), -1)) - 1) AS h FROM flat),
snips AS (SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE concat(CASE WHEN strlen(h) > 60 THEN h ELSE c END, '…') END AS snippet FROM heads),
found AS (SELECT k.query_id, m.kind, m.id, m.what, m.learned, row_number() OVER (PARTITION BY k.query_id, m.kind ORDER BY round(score, 9), m.id) AS p FROM bm b JOIN key k USING (query_id) JOIN memories m ON m.id = b.id AND m.task_type = k.task_type AND m.kind IN ('error_resolution', 'task_pattern'))
{parts} UNION ALL SELECT query_id, kind, p, id, {text} FROM found JOIN snips USING (id) WHERE p <= {most}""")


for _mode in S.MODES:
    register(f"w6_context_{_mode}", _bundle(_mode), _bundle_sql(_mode))

# ---- ingest ----------------------------------------------------------------------------------
_I2 = "substr(what, 1, 190)"
on("i2_validation", "save_requests", lambda m: m.withColumn("title", F.substring("what", 1, 190)).select("id", S.validation_error().alias("error")),
   rf"SELECT id, CASE WHEN regexp_full_match({_I2}, '[ \t\n\r\f\v]*') THEN 'title:required' WHEN regexp_full_match(learned, '[ \t\n\r\f\v]*') THEN 'learned:required' WHEN strlen({_I2}) > 200 THEN 'title:too_long' WHEN strlen(what) > 8192 THEN 'what:too_long' WHEN strlen(learned) > 4096 THEN 'learned:too_long' END AS error FROM save_requests")
on("i5_exact_dedupe", "memories", lambda m: S.exact_duplicates(m.withColumn("fingerprint", T.fingerprint(F.col("learned")))),
   f"WITH f AS (SELECT id, created_at, array_to_string(list_sort({_w('learned', '')}), ' ') AS fp FROM memories), k AS (SELECT *, first_value(id) OVER (PARTITION BY fp ORDER BY created_at, id) AS first FROM f) SELECT id, CASE WHEN id = first THEN 'saved' ELSE 'duplicate' END AS status, CASE WHEN id <> first THEN first END AS matched_id FROM k")
on("i7_force", "memories", lambda m: S.merge_forced(m, m.where("doc_id % 11 = 0").select("fingerprint", F.lower("title").alias("title"), "what", F.reverse("learned").alias("learned"), "tags", F.lit("shared").alias("scope"), F.lit(NOW).cast("long").alias("updated_at"))).select("id", "title", "learned", "scope", "created_at", "updated_at"),
   f"WITH u AS (SELECT fingerprint, lower(title) AS t, reverse(learned) AS l FROM memories WHERE doc_id % 11 = 0) SELECT m.id, coalesce(u.t, title) AS title, coalesce(u.l, learned) AS learned, CASE WHEN u.t IS NULL THEN scope ELSE 'shared' END AS scope, created_at, CASE WHEN u.t IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM memories m LEFT JOIN u USING (fingerprint)")
on("i9_supersede", "memories", lambda m: S.supersede(m, m.where("doc_id % 2 = 1").select("kind", "task_type", F.lit("shared").alias("scope"), F.concat(F.lit("mem_"), F.lpad((F.col("doc_id") - 80).cast("string"), 10, "0")).alias("supersedes"))).select("id"),
   "SELECT id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memories n WHERE n.doc_id % 2 = 1 AND n.doc_id - 80 = m.doc_id AND n.kind = m.kind AND n.task_type = m.task_type AND m.scope = 'shared')")
on("i11_prune", "memories", lambda m: m.where(S.prune(m, NOW, kind="session_summary", days=330)).select("id", "created_at"), f"SELECT id, created_at FROM memories WHERE kind = 'session_summary' AND created_at < {NOW} - 330 * 86400")
on("i13_set_scope", "memories", lambda m: S.set_scope(m, m.where("doc_id % 4 = 0").select("id"), "shared").select("id", "scope", "updated_at"), "SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'shared' ELSE scope END AS scope, updated_at FROM memories")
on("i15_schema_ladder", "memories", lambda m: S.add_missing(m.select("id", "title"), 0).select("id", "scope", "expand_count", "origin", "pinned"), "SELECT id, 'personal' AS scope, 0::BIGINT AS expand_count, 'manual' AS origin, FALSE AS pinned FROM memories")


def i17_index_doctor(spark, sf_dir):
    m = view(spark, sf_dir, "memories")
    stored, rebuilt = R.build(m.where("doc_id % 13 <> 0")).postings, R.build(m.where("doc_id % 17 <> 0")).postings
    return S.index_difference(stored, rebuilt)


register("i17_index_doctor", i17_index_doctor, cte(f"WITH {_MEM_INDEX}, p AS (SELECT doc_id FROM postings JOIN memories USING (id)) SELECT 'missing' AS side, count(*) AS n FROM p WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0 UNION ALL SELECT 'stale', count(*) FROM p WHERE doc_id % 13 <> 0 AND doc_id % 17 = 0"))
