"""Operators over keys that many rows share: the same rows as from pairs, without the pairs."""

from pyspark.sql import functions as F

from lessonlake.operators import graph, retrieval


def shapes(spark):
    symbols = spark.createDataFrame([(i, f"p.{'abc'[i % 3]}{i}", "p") for i in range(40)], "id long, qname string, package string")
    of = lambda rows, name: spark.createDataFrame(rows, f"{name} long, shape string")
    return symbols, graph.Shapes(of([(0, "x"), (1, "x"), (2, "y"), (3, "z")], "iface"), of([(i, "x" if i % 2 else "y") for i in range(10, 40)], "impl"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_totals_of_shapes(spark):
    assert rows(shapes(spark)[1].totals()) == [(0, 15), (1, 15), (2, 15)]


def test_satisfies_by_shape(spark):
    symbols, found = shapes(spark)
    assert rows(found.satisfies(symbols, 1)) == rows(graph.satisfies(found.pairs(), symbols, 1)) != []


def test_implementers_by_shape(spark):
    symbols, found = shapes(spark)
    assert rows(found.implementers(symbols, 4)) == rows(graph.implementers(found.pairs(), symbols, 4)) != []


def test_names_by_shape(spark):
    symbols, found = shapes(spark)
    assert rows(found.named(symbols)) == rows(found.pairs().join(symbols, F.col("impl") == F.col("id")).select("iface", "qname")) != []


def test_dispatch_by_shape(spark):
    _, found = shapes(spark)
    calls = spark.createDataFrame([(12, "y", "Run"), (12, "x", "Run"), (12, "y", "Run"), (7, "z", "Run"), (8, "x", "Stop")], "caller long, shape string, method string")
    methods = found.impls.select(F.col("impl").alias("id"), "impl", F.lit("Run").alias("method"))
    pairs = calls.join(found.ifaces, "shape").select("caller", "iface", "method")
    assert rows(found.dispatch(calls, methods)) == rows(graph.dispatch(pairs, found.pairs(), methods)) != []


def most_rows(spark, run):
    """Result of ``run()`` and the most records that any of its stages shuffled."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()).iterator()
        out = {}
        while found.hasNext():
            stage = found.next()
            out[stage.stageId()] = stage.shuffleWriteRecords()
        return out

    before = stages()
    result = run()
    return result, max(n for i, n in stages().items() if i not in before)


def test_satisfied_shuffles_no_pairs(spark):
    needs = spark.createDataFrame([(i, m) for i in range(200) for m in ("a", "b")] + [(999, None)], "iface long, method string")
    has = spark.createDataFrame([(i, m) for i in range(200) for m in ("a", "b", "c")] + [(500, "a")], "impl long, method string")
    got, most = most_rows(spark, lambda: graph.satisfied(needs, has).collect())
    assert len(got) == 40000 and {r.impl for r in got} == set(range(200)) and most < 20000


def test_resolve_shuffles_no_pairs(spark):
    symbols = spark.createDataFrame([(i, f"p.n.{i}", "n") for i in range(300)], "id long, qname string, name string")
    asked = spark.createDataFrame([(i, "n") for i in range(300)], "query_id long, name string")
    got, most = most_rows(spark, lambda: graph.resolve(asked, symbols).collect())
    first = sorted(range(300), key=lambda i: f"p.n.{i}")[:20]
    assert sorted((r.query_id, r.id) for r in got) == sorted((q, i) for q in range(300) for i in first) and all(r.ambiguous and r.tier == 2 for r in got) and most < 20000


def full_graph(spark, n):
    return spark.createDataFrame([(a, b) for a in range(n) for b in ((a + 1) % n, (a + 7) % n, (a * 3 + 1) % n, (a * 5 + 2) % n) if a != b], "caller long, callee long").distinct()


def test_neighbours_stop_at_the_cap(spark):
    edges = full_graph(spark, 400)
    symbols = spark.createDataFrame([(i, f"q{i:03}", f"p{i % 3}") for i in range(400)], "id long, qname string, package string")
    got, most = most_rows(spark, lambda: rows(graph.neighbours(symbols, symbols, edges, False, 5, 4)))
    near = graph.nearest_direct(symbols, edges.select(F.col("caller").alias("callee"), F.col("callee").alias("caller")), 4)
    assert len(got) == 1600 and set(rows(near)) <= {(s, i, p) for s, p, i, _ in got} and most < 12000


def test_paths_meet_in_the_middle(spark):
    edges = full_graph(spark, 60)
    out = {}
    for r in edges.collect():
        out.setdefault(r.caller, []).append(r.callee)
    want = {}
    for start in range(0, 60, 7):
        paths, level = {start: [start]}, {start: [start]}
        while level:
            longer = {}
            for path in level.values():
                for n in out[path[-1]]:
                    if n not in paths:
                        longer[n] = min(longer.get(n, [99]), [*path, n])
            paths |= longer
            level = longer
        want |= {(start, t): paths[t] for t in (3, 30, 59, start)}
    asked = spark.createDataFrame([*want, (3, 1000)], "start long, target long")
    assert {(r.start, r.target): r.path for r in graph.shortest_path(asked, edges).collect()} == want
    line = spark.createDataFrame([(i, i + 1) for i in range(12)], "caller long, callee long")
    asked = spark.createDataFrame([(0, t) for t in range(13)], "start long, target long")
    assert sorted(len(r.path) for r in graph.shortest_path(asked, line).collect()) == list(range(1, 12))


def test_hints_count_shapes(spark):
    _, found = shapes(spark)
    asked = spark.createDataFrame([(i, "interface") for i in range(4)], "id long, kind string")
    edges = spark.createDataFrame([], "caller long, callee long")
    assert rows(graph.hints(asked, edges, found)) == rows(graph.hints(asked, edges, found.pairs())) == [(0, "interface", 15), (1, "interface", 15), (2, "interface", 15), (3, "interface", 0)]


def test_symbols_that_match_alike_are_scored_once(spark):
    symbols = spark.createDataFrame([(i, f"p.{'abcd'[i % 4]}_x", f"{'abcd'[i % 4]}_x", "", "sig" if i % 3 else "sig other") for i in range(240)], "id long, qname string, name string, doc string, signature string")
    asked = spark.createDataFrame([(i, f"{'abcd'[i % 4]}_x sig") for i in range(60)] + [(99, "nothing")], "query_id long, query string")
    got = rows(retrieval.symbol_search(asked, symbols))
    index = retrieval.build(symbols, ("qname", "name", "doc", "signature"), extra="")
    hits = retrieval.bm25(retrieval.term_phrases(asked, retrieval.T.symbol_terms(F.col("query")), ""), index).collect()
    want = []
    for q in range(60):
        best = sorted((round(h.score, 9), h.id) for h in hits if h.query_id == q)[:10]
        want += [(q, k + 1, i, round(s, 6)) for k, (s, i) in enumerate(best)]
    assert [r[:3] for r in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want)))
