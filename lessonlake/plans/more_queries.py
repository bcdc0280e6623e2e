"""Browse tier, ingest as a whole, remaining graph parts and audit outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlake.operators import graph as G
from lessonlake.operators import retrieval as R
from lessonlake.operators import scrub as P
from lessonlake.operators import store as S
from lessonlake.plans.graph_queries import _ask, shapes
from lessonlake.plans.registry import register
from lessonlake.plans.retrieval_queries import _MEM_INDEX, _REQ, _bm25_sql, _phrase_sql
from lessonlake.plans.views import cte, view


def w5_browse_tier(spark, sf_dir):
    m = view(spark, sf_dir, "memories")
    index = R.build(m)
    requests = view(spark, sf_dir, "search_requests").withColumn("task_type", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return R.browse_kinds(requests, m, index, S.KINDS[:2], 5).select("query_id", "kind", "rank", "id")


register("w5_browse_tier", w5_browse_tier, cte(f"""WITH {_MEM_INDEX}, {_REQ}, {_phrase_sql('req', 'query')}, {_bm25_sql(R.WEIGHTED)},
ranked AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY round(score, 9), b.id) AS rank, b.id FROM bm b JOIN memories m ON m.id = b.id AND m.kind IN ('error_resolution', 'task_pattern') AND m.task_type = concat('src', (query_id % 20)::STRING))
SELECT query_id, kind, rank, id FROM ranked WHERE rank <= 5"""))


def i1_ingest(spark, sf_dir):
    rows = view(spark, sf_dir, "save_requests").withColumns({"task_type": F.substring("tags", 1, 2), "kind": F.lit("task_pattern")})
    return S.ingest(rows)


register("i1_ingest", i1_ingest)
register("i10_dry_run", lambda s, d: i1_ingest(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
register("i8_upsert", lambda s, d: S.upsert(view(s, d, "memories").withColumn("fingerprint", F.sha2("what", 256))).select("id", "origin", "created_at", "updated_at", "tags"), cte("SELECT min_by(id, created_at) AS id, min_by(origin, created_at) AS origin, min(created_at) AS created_at, max(updated_at) AS updated_at, max_by(tags, created_at) AS tags FROM memories GROUP BY sha256(what)"))
register("g2_describe", lambda s, d: G.describe(_ask(view(s, d, "symbols")), view(s, d, "symbols"), view(s, d, "edges"), shapes(view(s, d, "symbols"))))
register("g7_with_methods", lambda s, d: G.with_methods(view(s, d, "symbols").where("kind = 'type'").select("id", F.col("package").alias("qname")), view(s, d, "symbols").where("kind = 'method'").select(F.concat_ws(".", "package", F.replace("name", F.lit("."), F.lit("_"))).alias("qname"))).select("id"), cte("SELECT id FROM symbols t WHERE kind = 'type' AND EXISTS (SELECT 1 FROM symbols m WHERE m.kind = 'method' AND m.package = t.package)"))
register("g8_edge_totals", lambda s, d: G.edge_totals(view(s, d, "symbols"), view(s, d, "edges"), True, 2), cte("SELECT callee AS id, count(DISTINCT caller) AS total FROM edges GROUP BY callee HAVING count(DISTINCT caller) > 2"))


def a11_fold_reports(spark, sf_dir):
    fields = P.scrub_fields(view(spark, sf_dir, "memories").select("id", "title", "what", "learned"), ("title", "what", "learned"))
    return P.by_pattern(fields)


register("a11_fold_reports", a11_fold_reports)
