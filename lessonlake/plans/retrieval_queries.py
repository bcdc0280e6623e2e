"""Retrieval queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlake.functions.stem import stem_vocabulary
from lessonlake.operators import retrieval as R
from lessonlake.operators import sessions as E
from lessonlake.plans.registry import register
from lessonlake.plans.views import cte, view

_TOK = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}{}]+'), lambda x: x <> '')"


def _index_sql(rows: str, columns: tuple[str, ...], extra: str = "_-", prefix: str = "") -> str:
    cells = " UNION ALL ".join(f"SELECT id, {i} AS col, {_TOK.format(f"coalesce({c}, '')", extra)} AS tokens FROM {rows}" for i, c in enumerate(columns))
    return f"""{prefix}cells AS ({cells}),
{prefix}stats AS (SELECT id, sum(len(tokens))::BIGINT AS d FROM {prefix}cells GROUP BY id),
{prefix}totals AS (SELECT count(*) AS n, avg(d) AS avg_d FROM {prefix}stats),
{prefix}postings AS (SELECT id, col, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM {prefix}cells)"""


def _phrase_sql(source: str, query: str) -> str:
    return rf"""pieces AS (
  SELECT query_id, piece, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array({query}, '[\t\n\f\r ]+'), lambda x: x <> '')) AS piece FROM {source}) t GROUP BY ALL),
phrases AS (SELECT *, {_TOK.format('piece', '_-')} AS tokens FROM pieces WHERE len({_TOK.format('piece', '_-')}) > 0)"""


def _bm25_sql(weights: tuple[float, ...]) -> str:
    weight = f"list_extract([{', '.join(f'{w}::DOUBLE' for w in weights)}], col + 1)"
    return f"""spots AS (SELECT piece, len(tokens) AS n, unnest(tokens) AS term, unnest(range(len(tokens))) AS off FROM (SELECT DISTINCT piece, tokens FROM phrases) t),
runs AS (SELECT piece, id, col, pos - off AS start FROM postings JOIN spots USING (term) GROUP BY piece, id, col, pos - off, n HAVING count(DISTINCT off) = n),
hits AS (SELECT piece, id, sum({weight}) AS tf FROM runs GROUP BY piece, id),
df AS (SELECT piece, count(*) AS df FROM hits GROUP BY piece),
idf AS (SELECT piece, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM df, totals),
bm AS (
  SELECT query_id, h.id, -sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avg_d))) AS score
  FROM hits h JOIN idf USING (piece) JOIN stats s ON s.id = h.id CROSS JOIN totals JOIN phrases p USING (piece)
  GROUP BY query_id, h.id)"""



def _tokens_sql(text: str, instead: str = " ") -> str:
    """Distinct long words; a set, so their order does not matter."""
    return rf"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({text}), '[^0-9A-Za-z_\t\n\f\r -]', '{instead}', 'g'), '[\t\n\f\r ]+', ' ', 'g'), ' '), lambda x: strlen(x) > 2))"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


_MEM_INDEX = _index_sql("memories", R.COLUMNS)
_REQ = "req AS (SELECT query_id, query FROM search_requests)"


def _memories(spark, sf_dir):
    return view(spark, sf_dir, "memories")


def t1_tokens(spark, sf_dir):
    index = R.build(_memories(spark, sf_dir))
    return index.postings.groupBy("id", "col").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("terms"))


register("t1_tokens", t1_tokens, cte(f"WITH {_MEM_INDEX} SELECT id, col, count(*) AS tokens, count(DISTINCT term) AS terms FROM postings GROUP BY id, col"))


def t1_stemmed_vocabulary(spark, sf_dir):
    index = R.build(_memories(spark, sf_dir))
    return stem_vocabulary(index.postings.select("term").distinct())


register("t1_stemmed_vocabulary", t1_stemmed_vocabulary)


def t2_index_stats(spark, sf_dir):
    index = R.build(_memories(spark, sf_dir))
    return R.term_stats(index)


register("t2_index_stats", t2_index_stats, cte(f"WITH {_MEM_INDEX} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM postings GROUP BY term"))


def _requests(spark, sf_dir):
    return view(spark, sf_dir, "search_requests")


def t3_phrase_match(spark, sf_dir):
    index, requests = R.build(_memories(spark, sf_dir)), _requests(spark, sf_dir)
    # pairs of neighbouring words, joined by a dot, are phrases of two tokens
    two = requests.select("query_id", F.regexp_replace("query", r"([^\t\n\f\r ]+)[\t\n\f\r ]+([^\t\n\f\r ]+)", "$1.$2").alias("query"))
    return R.match(R.query_phrases(two, index), index, R.WEIGHTED)


register("t3_phrase_match", t3_phrase_match, cte(rf"""WITH {_MEM_INDEX},
req AS (SELECT query_id, regexp_replace(query, '([^\t\n\f\r ]+)[\t\n\f\r ]+([^\t\n\f\r ]+)', '\1.\2', 'g') AS query FROM search_requests),
{_phrase_sql('req', 'query')}, {_bm25_sql(R.WEIGHTED)} SELECT piece, id, tf FROM hits"""))


def t4_bm25(spark, sf_dir):
    index = R.build(_memories(spark, sf_dir))
    scored = R.bm25(R.query_phrases(_requests(spark, sf_dir), index), index)
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


register("t4_bm25", t4_bm25, cte(f"WITH {_MEM_INDEX}, {_REQ}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.FLAT)} SELECT query_id, id, CASE WHEN abs(score) < 5e-7 THEN 0.0 ELSE round(score, 6) END AS score FROM bm"))


def t5_search(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    return R.search(_requests(spark, sf_dir), memories, R.build(memories))


def _search_tail(limit: int = 5, fetch: int = 15) -> str:
    return f"""ranked AS (
  SELECT b.*, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 9), b.id) AS bm25_rank FROM bm b {{where}}),
blended AS (
  SELECT r.*, CASE WHEN len({_tokens_sql('q.query')}) = 0 THEN 0.0 ELSE len(list_intersect({_tokens_sql('q.query')}, {_tokens_sql("concat_ws(' ', m.title, m.learned)")}))::DOUBLE / len({_tokens_sql('q.query')}) END AS overlap
  FROM ranked r JOIN req q USING (query_id) JOIN memories m ON m.id = r.id WHERE bm25_rank <= {fetch}),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score - 2.0::DOUBLE * overlap, 9), bm25_rank) AS rank FROM blended)
SELECT query_id, rank, id, CASE WHEN abs(score) < 5e-7 THEN 0.0 ELSE round(score, 6) END AS score, round(overlap, 6) AS overlap, total FROM final WHERE rank <= {limit}"""


_SEARCH_TAIL = _search_tail()
register("t5_search", t5_search, cte(f"WITH {_MEM_INDEX}, {_REQ}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.FLAT)}, {_SEARCH_TAIL.format(where='')}"))


def t5_search_filtered(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    requests = _requests(spark, sf_dir).withColumn("kind", F.lit("task_pattern"))
    return R.search(requests, memories, R.build(memories))


_ONE_KIND = "JOIN memories k ON k.id = b.id AND k.kind = 'task_pattern'"
register("t5_search_filtered", t5_search_filtered, cte(f"WITH {_MEM_INDEX}, {_REQ}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.FLAT)}, {_SEARCH_TAIL.format(where=_ONE_KIND)}"))


def t6_browse(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    requests = _requests(spark, sf_dir).withColumns({"task_type": F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")), "kind": F.lit("error_resolution")})
    return R.browse(requests, memories, R.build(memories))


register("t6_browse", t6_browse, cte(f"""WITH {_MEM_INDEX}, {_REQ}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.WEIGHTED)},
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), b.id) AS rank FROM bm b JOIN memories m ON m.id = b.id AND m.kind = 'error_resolution' AND m.task_type = concat('src', (query_id % 20)::STRING))
SELECT query_id, rank, id, CASE WHEN abs(score) < 5e-7 THEN 0.0 ELSE round(score, 6) END AS score FROM ranked WHERE rank <= 10"""))

_SEEDS = "doc_id % 20 = 0"


def _seed_sql(view_name: str) -> str:
    body = "concat_ws(' ', title, what, learned, tags)"
    return rf"""seeds AS (SELECT * FROM {view_name} WHERE {_SEEDS}),
bodies AS (SELECT id, task_type, kind, {_tokens_sql(body)} AS toks FROM {view_name}),
terms AS (SELECT s.id AS query_id, list_slice(list_transform(list_sort(list_transform(b.toks, lambda x: {{'n': -strlen(x), 't': x}})), lambda x: x.t), 1, 100) AS ts FROM seeds s JOIN bodies b USING (id)),
phrases AS (SELECT query_id, piece, 1 AS times, {_TOK.format('piece', '_-')} AS tokens FROM (SELECT query_id, unnest(ts) AS piece FROM terms) t WHERE len({_TOK.format('piece', '_-')}) > 0)"""


def _seeded(view_name):
    def frames(spark, sf_dir):
        rows = view(spark, sf_dir, view_name)
        return rows.where(_SEEDS), rows, R.build(rows)

    return frames


register("t7_nearest_duplicate", lambda s, d: R.nearest_duplicate(*_seeded("memories_dd")(s, d)), cte(f"""WITH {_index_sql('memories_dd', R.COLUMNS)}, {_seed_sql('memories_dd')}, {_bm25_sql(R.WEIGHTED)},
ranked AS (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(score, 9), b.id) AS r, x.toks AS a, y.toks AS c
  FROM bm b JOIN bodies x ON x.id = b.query_id JOIN bodies y ON y.id = b.id AND y.task_type = x.task_type AND y.kind = x.kind WHERE b.query_id <> b.id),
scored AS (SELECT query_id, id, r, {_jac('a', 'c')} AS jaccard FROM ranked WHERE r <= 20)
SELECT query_id AS seed_id, id, round(jaccard, 6) AS jaccard FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, r) = 1"""))
register("t8_neighbours", lambda s, d: R.neighbours(*_seeded("memories")(s, d)), cte(f"""WITH {_MEM_INDEX}, {_seed_sql('memories')}, {_bm25_sql(R.WEIGHTED)},
ranked AS (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(score, 9), b.id) AS r, x.toks AS a, y.toks AS c
  FROM bm b JOIN bodies x ON x.id = b.query_id JOIN bodies y ON y.id = b.id WHERE b.query_id <> b.id),
scored AS (SELECT query_id, id, r, {_jac('a', 'c')} AS jaccard FROM ranked WHERE r <= 20),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, r) AS rank FROM scored WHERE jaccard > 0)
SELECT query_id AS seed_id, rank, id, round(jaccard, 6) AS jaccard FROM final WHERE rank <= 5"""))


def t9_symbol_search(spark, sf_dir):
    symbols = view(spark, sf_dir, "symbols").withColumn("doc", F.lit(""))
    requests = symbols.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "name", "signature").alias("query"))
    return R.symbol_search(requests, symbols)


register("t9_symbol_search", t9_symbol_search, cte(rf"""WITH syms AS (SELECT *, '' AS doc FROM symbols), {_index_sql('syms', ('qname', 'name', 'doc', 'signature'), '')},
asked AS (SELECT id AS query_id, unnest(list_filter(regexp_split_to_array(concat_ws(' ', name, signature), '[^\p{{L}}\p{{Nd}}_]+'), lambda x: strlen(x) >= 2)) AS piece FROM symbols WHERE id % 20 = 0),
phrases AS (SELECT query_id, piece, count(*) AS times, any_value({_TOK.format('piece', '')}) AS tokens FROM asked GROUP BY query_id, piece), {_bm25_sql(R.FLAT)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM bm)
SELECT query_id, rank, id, CASE WHEN abs(score) < 5e-7 THEN 0.0 ELSE round(score, 6) END AS score FROM ranked WHERE rank <= 10"""))


def t5_search_stemmed(spark, sf_dir):
    """The search over stems; SQL has no stemmer, so tests compare it with FTS5."""
    memories = _memories(spark, sf_dir)
    return R.search(_requests(spark, sf_dir), memories, R.build(memories, stem=stem_vocabulary))


register("t5_search_stemmed", t5_search_stemmed)


def _pulled(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    prompts = view(spark, sf_dir, "prompts").select(F.concat_ws(":", F.col("session").cast("string"), F.col("seq").cast("string")).alias("query_id"), "query")
    found = R.pull(prompts, memories, R.build(memories), limit=10)
    split = F.split("query_id", ":")
    return E.relevance_pull(found.select(split[0].cast("long").alias("session"), split[1].cast("long").alias("seq"), "rank", "id", "overlap"))


_PULL = f"""WITH RECURSIVE {_MEM_INDEX}, req AS (SELECT concat(session::STRING, ':', seq::STRING) AS query_id, query FROM prompts), {_phrase_sql('req', 'query')}, {_bm25_sql(R.FLAT)},
found AS ({_search_tail(10, 30).format(where='').replace("ranked AS (", "WITH ranked AS (", 1)}),
cand AS (SELECT split_part(query_id, ':', 1)::BIGINT AS session, split_part(query_id, ':', 2)::BIGINT AS seq, rank, id, overlap FROM found),
p AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS k, list(id ORDER BY rank) AS ids FROM cand WHERE overlap >= 0.3 GROUP BY session, seq),
f(session, seq, k, fresh, had) AS (
  SELECT session, seq, k, ids[1:3], ids[1:3] FROM p WHERE k = 1
  UNION ALL SELECT p.session, p.seq, p.k, list_filter(p.ids, lambda x: NOT list_contains(f.had, x))[1:3], list_concat(f.had, list_filter(p.ids, lambda x: NOT list_contains(f.had, x))[1:3]) FROM f JOIN p ON p.session = f.session AND p.k = f.k + 1),
marked AS (SELECT c.*, coalesce(list_contains(f.fresh, c.id), FALSE) AS picked, coalesce(len(f.fresh), 0) AS n FROM cand c LEFT JOIN f ON f.session = c.session AND f.seq = c.seq),
looked AS (SELECT *, max(CASE WHEN picked THEN rank END) OVER (PARTITION BY session, seq) AS last FROM marked) """
register("t10_relevance_gate", lambda s, d: _pulled(s, d).where("picked").select("session", "seq", "rank", "id", "overlap"), cte(_PULL + "SELECT session, seq, rank, id, overlap FROM looked WHERE picked"))
register("r8_injected_once", lambda s, d: _pulled(s, d).where("picked").select("session", "id", "seq"), cte(_PULL + "SELECT session, seq, id FROM looked WHERE picked"))
register("r10_tuning_log", lambda s, d: _pulled(s, d), cte(_PULL + "SELECT session, seq, rank, id, overlap, overlap >= 0.3 AS passed, picked FROM looked WHERE n < 3 OR rank <= last"))
