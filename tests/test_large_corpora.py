"""Joins and searches over many documents: all results, from few candidates."""

import random

from pyspark.sql import functions as F

from lessonlake.operators import dedupe, retrieval


def lessons(spark, texts):
    rows = [(f"m{i:03}", i, "t", "k", "", t, "", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, created_at long, task_type string, kind string, title string, what string, learned string, tags string")


def test_similar_pairs_from_few_candidates(spark, monkeypatch):
    pick, words = random.Random(3), [f"w{i:03}" for i in range(400)]
    # 60 texts share a rare word, and ten have a near copy; the short ones have all tokens in common or few
    texts = [" ".join(pick.sample(words, 60)) + " rare" for _ in range(60)]
    texts += [" ".join(t.split()[:-6]) + f" new{i} newer{i}" for i, t in enumerate(texts[:10])]
    texts += ["aaa bbb ccc", "aaa bbb ccc ddd", "aaa bbb ccc ddd eee", "aaa", "aaa zzz", "bbb ccc aaa", ""]
    rows, written = lessons(spark, texts), {}

    def note(df, name, put=dedupe.materialize):
        written[name] = (out := put(df, name)).count()
        return out

    monkeypatch.setattr(dedupe, "materialize", note)
    sets = [frozenset(t.split()) for t in texts]
    for threshold in (0.6, 0.85):
        got = {(r.earlier, r.later): r.jaccard for r in dedupe.similar_pairs(rows, threshold).collect()}
        reps = [i for i, s in enumerate(sets) if s and s not in sets[:i]]
        want = {(f"m{i:03}", f"m{j:03}"): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in reps for j in reps if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        want[("m070", "m075")] = 1.0
        assert got == want and len(want) > 8
        assert written["met-sets"] < 3 * len(want)


def test_phrases_meet_whole_runs(spark, monkeypatch):
    rows = lessons(spark, ["the a the b", "the the the", "b.c d", ""] + ["the x"] * 50)
    index = retrieval.build(rows)
    monkeypatch.setattr(index, "postings", None)  # places of single tokens are not read
    phrases = retrieval.query_phrases(spark.createDataFrame([(1, "the.the the,the THE b.c c.d e.f"), (2, "a.the.b a")], "query_id int, query string"), index)
    got = {(r.piece, r.id): r.tf for r in retrieval.match(phrases, index, retrieval.WEIGHTED).collect() if r.id < "m004"}
    two, one = {("m001"): 2.0}, {"m000": 2.0, "m001": 3.0}
    want = {(p, i): n for p, of in (("the.the", two), ("the,the", two), ("THE", one), ("b.c", {"m002": 1.0}), ("c.d", {"m002": 1.0}), ("a.the.b", {"m000": 1.0}), ("a", {"m000": 1.0})) for i, n in of.items()}
    assert got == want
    assert retrieval.match(phrases.where("query_id = 3"), index).collect() == []


def test_ingest_redacts_in_one_pass(spark):
    from lessonlake.operators import store

    row = ("a", 1, "s", "t", "task_pattern", "", "what", "learned", "x", "personal", "manual")
    rows = spark.createDataFrame([row, row], "id string, created_at long, session_id string, task_type string, kind string, title string, what string, learned string, tags string, scope string, origin string")
    # a join of the texts with what their identifiers hold would make four rows of two requests
    assert [tuple(r) for r in store.ingest(rows).select("id", "status", "error").collect()] == [("a", "invalid", "title:required")] * 2


def test_pull_is_search_without_totals(spark, monkeypatch):
    from lessonlake.operators import blocks

    monkeypatch.setattr(blocks, "_ROWS", 64)
    pick, words = random.Random(5), [f"w{int(1.15**i)}" for i in range(60)]
    rows = lessons(spark, [" ".join(pick.choices(words, k=pick.randrange(1, 30))) for _ in range(300)] + ["w1 w1"] * 40).withColumn("learned", F.col("what"))
    index = retrieval.build(rows)
    asked = spark.createDataFrame([(i, " ".join(pick.choices(words, k=6)) + " w1.w1 w1 w1") for i in range(12)] + [(50, "none.such"), (51, "?")], "query_id int, query string")
    want = retrieval.search(asked, rows, index, 10).drop("total")
    assert sorted(map(tuple, retrieval.pull(asked, rows, index, 10).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == 120
