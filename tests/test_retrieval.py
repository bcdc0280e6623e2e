"""BM25 against stdlib sqlite3 FTS5, and stems against its porter tokenizer."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lessonlake.functions.stem import porter, stem_vocabulary
from lessonlake.operators import retrieval as R

ROWS = [
    ("m1", "retry loop stalls", "the retry loop waits on a lock", "release the lock before retry", "retry lock"),
    ("m2", "parser drops field-mapping", "foo.bar is parsed twice", "split on foo bar once", "parser"),
    ("m3", "cache of the parser", "the cache keeps stale rows", "evict rows after retry", "cache the"),
    ("m4", "café menu rows", "the rows repeat", "sort rows first", "rows the"),
    ("m5", "unrelated entry", "nothing to see", "move on", "misc"),
]
QUERIES = ["retry", "retry retry", "foo.bar", "the rows", "lock parser", "field-mapping", "café"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, what, learned, tags, tokenize = \"porter unicode61 tokenchars '_-'\")")
    con.executemany("INSERT INTO f(rowid, title, what, learned, tags) VALUES (?,?,?,?,?)", [(int(r[0][1:]), *r[1:]) for r in ROWS])
    return con


@pytest.mark.parametrize("weights", [R.FLAT, R.WEIGHTED])
def test_bm25_is_fts5(spark, fts, weights):
    memories = spark.createDataFrame(ROWS, "id string, title string, what string, learned string, tags string")
    index = R.build(memories, stem=stem_vocabulary)
    requests = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    got = {(r.query_id, r.id): r.score for r in R.bm25(R.query_phrases(requests, index), index, weights).collect()}
    want = {}
    for i, q in enumerate(QUERIES):
        match = " OR ".join(f'"{p}"' for p in q.split())
        for rowid, score in fts.execute(f"SELECT rowid, bm25(f, {', '.join(map(str, weights))}) FROM f WHERE f MATCH ?", (match,)):
            want[(i, f"m{rowid}")] = score
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_porter_is_fts5():
    words = "generalizations ponies caresses cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controlling rolling at be phone_number field-mapping".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = \"porter unicode61 tokenchars '_-'\")")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?,?)", list(enumerate(words, 1)))
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert {w: porter(w) for w in words} == {w: want[i] for i, w in enumerate(words, 1)}


def test_search_total_limit_and_blank(spark):
    memories = spark.createDataFrame([(f"m{i}", "t", "k", f"alpha {i}", "alpha beta", "learned alpha", "") for i in range(30)], "id string, task_type string, kind string, title string, what string, learned string, tags string")
    index = R.build(memories)
    requests = spark.createDataFrame([(1, "alpha"), (2, "   "), (3, "nowhere")], "query_id long, query string")
    got = R.search(requests, memories, index, limit=5).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 5 and got[0].total == 30
    assert R.search(requests, memories, index, limit=500).where(F.col("query_id") == 1).count() == 20


def test_gates_and_metrics_take_every_row(spark):
    import os

    from lessonlake.plans import registry
    from lessonlake.plans.views import view

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    run = lambda name: registry.queries()[name](spark, sf_dir).collect()
    total = {r["class"]: r.n for r in run("a12_retrieval_metrics")}["overall"]
    assert total == view(spark, sf_dir, "memories").count()
    for name in ("t10_relevance_gate", "r10_tuning_log", "r8_injected_once"):
        assert any(r.session % 5 for r in run(name)), name


def test_stemmed_scores_are_fts5_on_whole_tables(spark):
    import os

    from lessonlake.plans.views import view

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    memories, requests = view(spark, sf_dir, "memories"), view(spark, sf_dir, "search_requests")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, what, learned, tags, tokenize = \"porter unicode61 tokenchars '_-'\")")
    ids = {}
    for i, r in enumerate(memories.select("id", *R.COLUMNS).collect(), 1):
        ids[i] = r.id
        con.execute("INSERT INTO f(rowid, title, what, learned, tags) VALUES (?,?,?,?,?)", (i, *r[1:]))
    index = R.build(memories, stem=stem_vocabulary)
    got = {(r.query_id, r.id): r.score for r in R.bm25(R.query_phrases(requests, index), index).collect()}
    want = {}
    for r in requests.collect():
        match = " OR ".join('"' + p.replace('"', '""') + '"' for p in r.query.split())
        want |= {(r.query_id, ids[rowid]): score for rowid, score in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if abs(got[k] - want[k]) > 1e-6][:5] == [], len([k for k in want if abs(got[k] - want[k]) > 1e-6])


def test_marks_fold_as_in_fts5(spark):
    words = ["e\u0301te\u0301", "\u1ea1bc", "\u01d6x", "Stra\u00dfe", "\u0142a", "\u00f8y", "na\u00efve", "x_\u00e9-y", "\u1e69", "\u0307q"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = \"unicode61 remove_diacritics 2 tokenchars '_-'\")")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?,?)", list(enumerate(words)))
    want = {i: [] for i in range(len(words))}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    rows = spark.createDataFrame(list(enumerate(words)), "i int, t string")
    assert {r.i: r.x for r in rows.select("i", R.tokenize(F.col("t")).alias("x")).collect()} == want
