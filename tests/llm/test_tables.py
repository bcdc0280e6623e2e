"""Vector searches, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import os
import re
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
import test_documents as documents
from lessonlake.llm import topk_bits, toxicity, vptree, warc


def vectors(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:80] = v[50]  # ties
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(n)]
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * dim), (1150, [None] * dim), (1200, [0.0] * dim), (1250, [float("inf")] * dim), (None, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), v


def expected(score, n, modulus, k, sign):
    out = {}
    for q in range(0, n, modulus):
        order = sorted((c for c in range(n) if c != q), key=lambda c: (sign * score[q][c], c))[:k]
        out |= {(q, r): c for r, c in enumerate(order, 1)}
    return out


def test_top_k_matches_brute_force(spark):
    df, v = vectors(spark)
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    score = x @ x.T
    got = topk_bits.top_k(df).where("query_id < 1000").collect()
    want = expected(score, 400, 50, 5, -1)
    zero = {(r.query_id, r.rank) for r in got if r.vec_id == 1200}
    assert not zero and {(r.query_id, r.rank): r.vec_id for r in got} == want
    assert all(r.score == score[r.query_id][r.vec_id] for r in got)


def test_nearest_is_exact_at_factor_one(spark):
    df, v = vectors(spark)
    d = np.sqrt(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1))
    got = vptree.nearest(df, factor=1.0).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in got} == expected(d, 400, 100, 10, 1)
    assert all(abs(r.score - d[r.query_id][r.vec_id]) < 1e-12 for r in got)


def test_several_blocks_give_the_same_rows(spark, monkeypatch):
    from lessonlake.llm import cells

    df, _ = vectors(spark, n=900)
    want = [sorted(map(tuple, f(df).collect())) for f in (topk_bits.top_k, lambda d: vptree.nearest(d, factor=1.0))]
    monkeypatch.setattr(cells, "ROW_BLOCK", 64)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    assert [sorted(map(tuple, f(df).collect())) for f in (topk_bits.top_k, lambda d: vptree.nearest(d, factor=1.0))] == want


def test_vectors_of_huge_components(spark):
    v = [[1e300, 1.0], [1e300, 2.0], [-1e300, 0.5], [1e17, 1e17], [2.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    floors = [[int(np.floor(256 * x)) for x in row] for row in v]
    scores = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(floors[0], floors[i], strict=True)))) for i in range(1, 5)}
    exact = sorted(range(1, 5), key=lambda i: (-sum(a * b for a, b in zip(floors[0], floors[i], strict=True)), i))
    got = {r.vec_id: r.score for r in topk_bits.top_k(df).collect()}
    assert got == scores and exact[0] == 1
    near = [(r.vec_id, r.score) for r in vptree.nearest(df).collect()]
    assert {i for i, _ in near} == {1, 2, 3, 4} and near[0] == (1, 1.0) and all(s == float("inf") for _, s in near[1:])


def test_relaxed_pruning_keeps_recall_on_whole_tables(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.4
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    d = np.sqrt(((v[::100, None] - v[None]) ** 2).sum(-1))
    want = {(100 * q, c) for q in range(60) for c in sorted((c for c in range(6000) if c != 100 * q), key=lambda c: (d[q][c], c))[:10]}
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(df, factor=1.0).collect()}
    near = {(r.query_id, r.vec_id) for r in vptree.nearest(df).collect()}
    assert exact == want and len(near & want) >= 0.95 * len(want)


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(2)
    v, ids = rng.normal(size=(3000, 12)), np.arange(3000)
    exact = vptree.VpTree(ids, v).search(ids[:60], v[:60], 10, 1.0)
    near = vptree.VpTree(ids, v).search(ids[:60], v[:60], 10, 0.8)
    pairs = lambda f: set(zip(f[0].tolist(), f[1].tolist(), strict=True))
    assert len(pairs(exact) & pairs(near)) >= 0.9 * len(pairs(exact))


def test_vectors_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    few = spark.createDataFrame([(0, [1.0, 2.0], 9), (0, [1.0, 2.0], 9), (1, [1.0, 0.0], 9), (2, [3.0], 9)], "vec_id long, embedding array<float>, score int")
    for search in (topk_bits.top_k, vptree.nearest):
        assert search(empty).count() == 0
        assert [(r.query_id, r.rank, r.vec_id) for r in search(few).collect()] == [(0, 1, 1)]


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/ d\n", ""), (5, "u", "é" * 200000), (None, "u", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (6, "u", "own")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, sha1 string, bytes int")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    keep = {"<p>x</p>": 2, "": 4, "é" * 200000: 5, "own": 6}
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = keep[html or ""]
        want.append((page or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == first else "revisit", 0 if page == first else first))
    assert got == sorted(want)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_members_frames_and_digests():
    payload = b"<html>" + b"y" * 100000
    data = warc.record(7, "http://x/", payload, len(payload), warc.digest(payload)) + warc.record(8, None, b"", len(payload), warc.digest(payload), 7)
    first, second = warc.read_records(io.BytesIO(data))
    assert first.payload == payload and (second.type, second.refers_to, second.payload_bytes) == ("revisit", 7, len(payload))
    with gzip.open(io.BytesIO(data)) as f:
        assert f.read().startswith(b"WARC/1.1\r\n")
    spoilt = warc.record(7, "http://x/", payload, len(payload), warc.digest(b"other"))
    for bad in (spoilt, data[: len(data) // 3]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        if name != "mixing":
            assert after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def slow_mix(rows, weights=(5, 2, 1)):
    """The texts of the mix by the documented rule; rows are (doc_id, text, source)."""
    size, total = {}, 0
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] = size.get(s, 0) + n
        total += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, left = {}, set(names)
    while True:
        spare = Fraction(3, 2) * total - sum(goal.values())
        share = {s: spare * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2 * size[s] for s in over}
        left -= over
    out = []
    for s in names:
        budget = math.floor(goal[s])
        mine = [(hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s]
        while budget > 0:
            for _, i, t in sorted(mine):
                words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
                if words and budget > 0:
                    out.append((i, t if budget >= len(words) else " ".join(words[:budget])))
                    budget -= len(words)
    return out


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts, labels = documents.toxic_tables(spark, 240)
    rows = [(r.doc_id, r.text, f"s{r.doc_id % 4}") for r in texts.collect()]
    for i, t, s in rows[7:60:9]:
        words = t.split()
        rows.append((1000 + i, " ".join([*words[:-1], "edit"]), s))  # near copies, and exact ones
        rows.append((2000 + i, t, "s2"))
    rows = [(i, f"{t} write to user{i}@mail.example.org today" if i % 5 == 1 else t, s) for i, t, s in rows] + [(5000, None, "s1"), (5001, "", None), (5002, "alone here", None)]
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    model = toxicity.train(table, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    kept = [r for r in rows if scores[r[0]] < 0.7]
    assert 0 < len(rows) - len(kept) < len(rows) // 3 and all(i % 6 == 0 for i, _, _ in set(rows) - set(kept) if i < 1000)
    roots = documents.slow_components({i: documents.slow_fingerprint(t) for i, t, _ in kept})
    unique = [r for r in kept if roots[r[0]] == r[0]]
    assert len(unique) < len(kept)
    found, clean = documents.slow_found([(i, t) for i, t, _ in unique]), []
    for i, t, s in unique:
        out, at = [], 0
        for k, a, b in sorted(found[i], key=lambda x: (x[1], x[2])):
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        clean.append((i, t if t is None else "".join(out) + t[at:], s))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in slow_mix(clean):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
