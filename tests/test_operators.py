"""Small hand-made cases: text functions, graph fixtures, greedy acceptance, sessions, import."""

import json

from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import dedupe, graph, sessions, store
from lessonlake.sources import hooks
from lessonlake.sources.pool import verdicts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_snippet_edges(spark):
    for text in ("a" * 120, "a" * 121, "é " * 70, "word " * 30, "a " + "b" * 200, "x" * 61 + " " + "y" * 100):
        flat = " ".join(text.split())
        want = flat
        if len(flat) > 120:
            cut = flat[:120]
            at = cut.rfind(" ")
            want = (cut[:at] if at >= 0 and len(cut[:at].encode()) > 60 else cut) + "…"
        assert one(spark, T.snippet(F.col("t")), t=text) == want


def test_words(spark):
    assert one(spark, F.array_join(T.tokens(F.col("t")), ","), t="Foo.bar, foo BAR café x-y ab") == "foo,bar,caf,x-y"
    assert one(spark, F.array_join(T.search_terms(F.col("t")), ","), t="Foo.bar, foo") == "foobar,foo"
    assert one(spark, T.valid_task_type(F.col("t")), t="abc\n") is True and one(spark, T.valid_task_type(F.col("t")), t="-abc") is False
    assert one(spark, T.entropy(F.col("t")), t="abcd") == 2.0


def test_truncated_counts_bytes(spark):
    for text in ("é" * 240, "a" + "é" * 240, "ab" + "漢" * 120, "abc" + "😀" * 90, "x" * 301, "x" * 300):
        data = text.encode()
        want = text if len(data) <= 300 else data[:300].decode("utf-8", "ignore") + "…[truncated]"
        assert one(spark, T.truncated(F.col("t"), 300), t=text) == want


def test_slug_near_misses(spark):
    rows = spark.createDataFrame([(t,) for t in ["a_b"] * 3 + ["A-B"] * 2 + ["a-b"] * 2 + ["c"]], "task_type string")
    assert {r.task_type: (r.n, r.other) for r in store.slug_near_misses(rows).collect()} == {"a_b": (3, "A-B"), "A-B": (2, "a_b"), "a-b": (2, "a_b"), "c": (1, None)}


MAIL = "write to jo" + "@" + "example.org now"
KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def test_ingest_as_one_flow(spark):
    words = " ".join(f"w{i}" for i in range(40))
    body = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [
        ("m1", "s", "deploy", "title one", words, MAIL, "", 1),
        ("m2", "s", "deploy", "title one", words, MAIL, "", 2),  # the same again
        ("m3", "s", "deploy", "title one", words + " extra", MAIL.replace("jo", "al"), "", 3),  # the same once redacted
        ("m4", "s", "deploy", "title two", words + " more", MAIL, "", 4),  # near
        ("m5", "s", "deploy", "title", body(5), "lesson", f"tag {KEY}", 5),
        ("m6", "s@example.org", "deploy", "title", body(6), "lesson", "", 6),
        ("m7", "s", "deploy", " ", body(7), "lesson", "", 7),
        ("m8", "s", "deploy", "title", body(8), "jo" + "@" + "example.org", "", 8),  # nothing is left
        ("m9", "s", "de_ploy", "other", body(9), "lesson nine", "", 9),
        ("n1", "s", "de-ploy", "another", body(10), "lesson ten", "", 10),
    ]
    table = spark.createDataFrame([(*r[:3], "task_pattern", *r[3:]) for r in rows], "id string, session_id string, task_type string, kind string, title string, what string, learned string, tags string, created_at long")
    table = table.withColumns({"scope": F.lit("personal"), "origin": F.lit("manual")})
    got = {r.id: (r.status, r.matched_id, r.error, r.slug_hint) for r in store.ingest(table).collect()}
    assert got == {
        "m1": ("saved", None, None, None), "m2": ("duplicate", "m1", None, None), "m3": ("duplicate", "m1", None, None), "m4": ("near_duplicate", "m1", None, None),
        "m5": ("invalid", None, "tags_contains_secret", None), "m6": ("invalid", None, "session_id_contains_secret", None), "m7": ("invalid", None, "title:required", None), "m8": ("invalid", None, "learned:emptied", None),
        "m9": ("saved", None, None, "de-ploy"), "n1": ("saved", None, None, "de_ploy"),
    }


def test_pull_stops_after_three_picks(spark):
    found = [(1, 0, r, f"m{r}", 0.2 if r == 2 else 0.5) for r in range(1, 7)] + [(1, 1, r, f"m{r}", 0.5) for r in range(1, 6)]
    got = sessions.relevance_pull(spark.createDataFrame(found, "session long, seq long, rank long, id string, overlap double")).collect()
    told = {(r.seq, r.rank): (r.passed, r.picked) for r in got}
    assert told == {(0, 1): (True, True), (0, 2): (False, False), (0, 3): (True, True), (0, 4): (True, True)} | {(1, r): (True, r in (2, 5)) for r in range(1, 6)}


def test_hook_lines(spark):
    lines = ['{"hook_event_name": "Post-Tool_Use", "session_id": "s", "tool_name": "Edit", "tool_input": {"notebook_path": "n"}}', "", "nothing", '{"hook_event_name": 5}', '{"hook_event_name": "Stop", "session_id": "s", "stop_hook_active": true}', '{"hook_event_name": "SessionStart"}', '{"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": " "}', '{"hook_event_name": "Stop"}']
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r.i: (r.event, r.path, r.handled) for r in hooks.parse(rows).collect()}
    assert got == {0: ("posttooluse", "n", True), 1: ("", None, False), 2: ("", None, False), 3: ("5", None, False), 4: ("stop", None, False), 5: ("sessionstart", None, True), 6: ("userpromptsubmit", None, False), 7: ("stop", None, False)}


def test_package_surface(spark):
    rows = [(1, "mod/x/util", "A", True, 3, "Does it.\nmore"), (2, "mod/x/util", "b", False, 1, ""), (3, "mod/util", "C", True, 2, " é" + "x" * 200), (4, "mod/util", "D", True, 9, "d")]
    symbols = spark.createDataFrame(rows, "id long, package string, name string, exported boolean, line long, doc string")
    asked = spark.createDataFrame([(1, "/util/"), (2, "x/util"), (3, "none")], "query_id long, name string")
    got = [(r.query_id, r.package, r.id, r.doc[:8], r.unexported, r.truncated) for r in graph.package_surface(asked, symbols, most=1).orderBy("query_id").collect()]
    assert got == [(1, "mod/util", 3, "éxxxxxxx", 0, True), (2, "mod/x/util", 1, "Does it.", 1, False)]


def test_describe(spark):
    symbols, implements, calls, methods = fanout(spark)
    symbols = symbols.withColumns({"kind": F.when(F.col("id") == 0, "interface").otherwise("func"), "signature": F.lit("")})
    edges = graph.dispatch(calls, implements, methods)
    asked = spark.createDataFrame([(1, "pkg.Store"), (2, "Save"), (3, "Mock.Save"), (4, "Echoes Echo")], "query_id long, name string")
    got = sorted((r.query_id, r.answer, r.id, r.hint) for r in graph.describe(asked, symbols, edges, implements).collect())
    assert got == [(1, "symbol", 0, 3), (2, "ambiguous", 7, None), (2, "ambiguous", 8, None), (2, "ambiguous", 9, None), (3, "symbol", 9, 2), (4, "menu", 5, None)]


def fanout(spark):
    names = ["Store", "Mem", "File", "Mock", "Broadcast", "Echo", "Run", "Mem.Save", "File.Save", "Mock.Save", "Lonely"]
    symbols = spark.createDataFrame([(i, f"pkg.{n}", n, "pkg") for i, n in enumerate(names)], "id long, qname string, name string, package string")
    implements = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "iface long, impl long")
    calls = spark.createDataFrame([(4, 0, "Save"), (5, 0, "Save")], "caller long, iface long, method string")
    methods = spark.createDataFrame([(7, 1, "Save"), (8, 2, "Save"), (9, 3, "Save")], "id long, impl long, method string")
    return symbols, implements, calls, methods


def test_fanout(spark):
    symbols, implements, calls, methods = fanout(spark)
    edges = graph.dispatch(calls, implements, methods)
    assert edges.count() == 6
    edges = edges.unionByName(spark.createDataFrame([(6, 4)], "caller long, callee long"))
    assert graph.transitive_callers(symbols.where("id = 9"), edges).first().callers == 3
    assert graph.transitive_callers(symbols.where("id = 6"), edges).first().callers == 0
    near = graph.neighbours(symbols.where("id = 9"), symbols, edges, True, 2, 1).collect()
    assert [(r.id, r.depth) for r in near] == [(4, 1)]
    pairs = spark.createDataFrame([(6, 9), (9, 6), (5, 5)], "start long, target long")
    assert {(r.start, r.target): r.path for r in graph.shortest_path(pairs, edges).collect()} == {(6, 9): [6, 4, 9], (5, 5): [5]}


def test_cycle_counts_the_start(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "caller long, callee long")
    assert graph.transitive_callers(spark.createDataFrame([(1,)], "id long"), edges).first().callers == 3


def test_greedy_is_sequential(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("c", "e")], "earlier string, later string")
    assert {r.id: r.seed for r in dedupe.greedy(pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "a"}


def test_near_duplicates_match_brute_force(spark):
    import random

    random.seed(5)
    vocabulary = [f"word{i}" for i in range(40)]
    texts = [" ".join(random.sample(vocabulary, 12)) for _ in range(12)]
    texts = [t if i % 3 else " ".join([*t.split()[:-1], "tail"]) for t in texts for i in range(3)]
    rows = spark.createDataFrame([(f"m{i:03}", "t", "k", x, "", "", "", i) for i, x in enumerate(texts)], "id string, task_type string, kind string, title string, what string, learned string, tags string, created_at long")
    jac = lambda a, b: len(a & b) / len(a | b)
    sets = [set(t.split()) for t in texts]
    accepted, want = [], {}
    for i, s in enumerate(sets):
        hit = next((j for j in accepted if jac(sets[j], s) >= 0.85), None)
        if hit is None:
            accepted.append(i)
        else:
            want[f"m{i:03}"] = f"m{hit:03}"
    assert {r.id: r.matched_id for r in dedupe.near_duplicates(rows).collect()} == want


def test_auto_retention_keeps_expanded(spark):
    rows = [(f"m{i:02}", "t", "session_summary", "auto", 1000 + i, 1 if i == 0 else 0, 5 if i == 0 else None) for i in range(31)]
    memories = spark.createDataFrame(rows, "id string, task_type string, kind string, origin string, created_at long, expand_count long, last_expanded_at long")
    assert {r[0] for r in rows} - {r.id for r in store.keep_auto(memories).collect()} == {"m01"}


def test_import_verdicts(spark):
    good = json.dumps({"kind": "user_rule", "task_type": "t", "title": "a", "what": "b", "learned": "c", "tags": ""})
    lines = spark.createDataFrame([(good,), (good,), ("",), ("{bad",)], "value string")
    none = spark.createDataFrame([], "fingerprint string")
    count = lambda df: {r.verdict: r["count"] for r in df.groupBy("verdict").count().collect()}
    first = verdicts(lines, none)
    assert count(first) == {"imported": 1, "skipped": 1, "failed": 1}
    assert count(verdicts(lines, first.where("verdict = 'imported'"))) == {"skipped": 2, "failed": 1}


def test_injected_once_caps_each_prompt(spark):
    rows = [(1, 0, r, f"m{r}") for r in range(1, 6)] + [(1, 1, r, f"m{r}") for r in range(1, 6)]
    got = sessions.injected_once(spark.createDataFrame(rows, "session long, seq long, rank long, id string")).collect()
    assert sorted((r.seq, r.id) for r in got) == [(0, "m1"), (0, "m2"), (0, "m3"), (1, "m4"), (1, "m5")]


def test_fresh_table_equals_migrated(spark):
    old = spark.createDataFrame([("m1", "t")], "id string, title string")
    fresh = store.add_missing(old, 0)
    assert store.add_missing(fresh, 2).schema == fresh.schema and fresh.columns[2:] == ["scope", "expand_count", "last_expanded_at", "origin", "review_after", "pinned"]
