"""Operators on documents against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lessonlake.llm import bpe, ctw, mixing, pii, simhash, substring, toxicity

TOXIC = ["wretch", "vermin", "dunce"]


def random_docs(n, seed):
    random.seed(seed)
    words = [a + b for a in "ka lo mi ru te".split() for b in "n s r l".split()]
    out = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 90))), f"s{i % 3}") for i in range(n)]
    for i in range(0, n, 4):  # near copies and shared passages
        parts = out[i][1].split()
        if len(parts) > 30:
            parts[random.randrange(len(parts))] = "edit"
            out.append((n + i, " ".join(parts), "s1"))
            out.append((2 * n + i, "before " + " ".join(parts[3:28]) + " after", "s2"))
    return out


# ---- mixing -------------------------------------------------------------------------------------
def test_mixing_budgets(spark):
    rows = random_docs(60, 1)
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {r.doc_id: len((dict((i, t) for i, t, _ in rows))[r.doc_id].split()) for r in got}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in got)
    total, weights = sum(sizes.values()), {"s0": 5, "s1": 2, "s2": 1}
    left, goal = set(weights), {}
    size = {s: sum(r.size for r in got if r.source == s) for s in weights}
    while True:
        spare = 1.5 * total - sum(goal.values())
        share = {s: spare * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2 * size[s] for s in over}
        left -= over
    for s in weights:
        assert sum(r.taken for r in got if r.source == s) == math.floor(goal[s] + 1e-9)
        assert all(abs(r.target - goal[s]) < 1e-6 for r in got if r.source == s)


def test_mix_rows_hold_what_is_taken(spark):
    rows = random_docs(60, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, words = Counter(), Counter()
    for r in mixing.mix_sizes(docs).collect():
        taken[r.doc_id] += r.taken
    for r in mixing.mix(docs).collect():
        words[r.doc_id] += len(r.text.split())
    assert +taken == +words


def test_mixing_odd_rows(docs, no_docs):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r.size == 0)
    assert {r.source for r in got} == {"a", "b", "c", "d", None}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {(r["a.b"], r["__text"], r.extra) for r in mixed.collect()} == {("dot", "t", "x")}
    assert mixing.mix_sizes(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mixing_without_ids(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "w " * (i % 9), "s") for i in range(400)] + [(None, None, None)] * 50, "doc_id long, text string, source string")
    sized = mixing._sized(docs)
    spread = [r["count"] for r in sized.where("size > 0").groupBy("bucket").count().collect()]
    assert len(spread) == 16  # 8 texts, with an id and without
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == 450 and sum(r.taken for r in got) == sum(r.size for r in got) * 3 // 2


# ---- simhash ------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rows = [(i, t) for i, t, _ in random_docs(60, 2)]
    random.seed(9)
    base = " ".join(f"w{i}" for i in range(900))
    for i in range(40):  # a chain of near copies
        parts = base.split()
        for _ in range(i % 5):
            parts[random.randrange(900)] = "zz"
        rows.append((1000 + i, " ".join(parts)))
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(prints)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_links_across_open_signatures(spark):
    random.seed(4)
    near = [random.getrandbits(64) for _ in range(30)]
    values = set(near)
    for v in near[:15]:
        values.add(v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
        values.add(v ^ 0b1111)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r.fp & (1 << 64) - 1: r.root for r in simhash.fingerprint_roots(nodes).collect()}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                assert roots[a] == roots[b]


def test_roots_of_a_hot_signature(spark):
    # one half is the same for all: strangers, near copies of one another, and chains between them
    random.seed(14)
    low = [random.getrandbits(32) for _ in range(400)]
    low += [low[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    values = sorted({0xABCD << 32 | v for v in low} | {0xABCF << 32 | v ^ 0b101 for v in low[:40]})
    got = {r.fp: r.root for r in simhash.fingerprint_roots(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = slow_components({v: v for v in values})
    assert {v: got.get(v, v) for v in values} == want


def test_every_link_shares_a_signature_and_a_piece():
    whole = (1 << 64) - 1
    pieces = [[m & whole for m in simhash._pieces(number)] for number in range(len(simhash._KEPT))]
    for own in pieces:
        assert sum(own).bit_count() == sum(m.bit_count() for m in own) and max(m.bit_count() for m in own) <= 9
    for bits in itertools.combinations(range(64), 3):  # fewer bits share all that these share
        flipped = sum(1 << b for b in bits)
        same = [own for own in pieces if not flipped & (whole ^ sum(own))]
        assert same and all(any(not flipped & m for m in own) for own in same)


def test_signatures_hold_the_kept_blocks(spark):
    random.seed(21)
    values = [0, (1 << 64) - 1, 1 << 63, *(random.getrandbits(64) for _ in range(20))]
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    numbers = range(len(simhash._KEPT))
    for row in signed.select("fp", F.array(*[simhash._signature(n) for n in numbers]).alias("sigs")).collect():
        for n in numbers:
            key, at = 0, 0
            for first, width in (simhash._BLOCKS[b] for b in simhash._KEPT[n]):
                key |= ((row.fp >> first) & ((1 << width) - 1)) << at
                at += width
            assert row.sigs[n] == n << 33 | key and at <= 33


def test_rows_shuffled_for_a_fingerprint(spark):
    # with no join broadcast, as on tables of any size: growth must not wait for the switch of a join
    random.seed(22)
    values = [random.getrandbits(63) for _ in range(3000)]
    values += [v ^ 0b11 for v in values[:20]]
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before, limit = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        roots = {r.fp: r.root for r in simhash.fingerprint_roots(nodes).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(roots) == 40 and all(roots[v] == roots[v ^ 0b11] for v in values[:20])
    rows = sum(n for at, n in stages().items() if at not in before)
    assert 20 * len(values) < rows < 50 * len(values)


def test_simhash_odd_rows(docs, no_docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == got[(3, "0" * 16)] == 1
    assert {c for (i, _), c in got.items() if i == 5} == {4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 6, 7, 8]
    assert {(r["a.b"], r.packed) for r in kept.collect()} == {("dot", "p")}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


# ---- substring ----------------------------------------------------------------------------------
def slow_cut(rows, n=20):
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - n + 1):
            k, at = tuple(w[p : p + n]), (i, p)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (i, p):
                gone[p : p + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substring_matches_brute_force(spark):
    rows = [(i, t) for i, t, _ in random_docs(60, 3)]
    random.seed(7)
    rows += [(5000 + i, " ".join(random.choice("ab") for _ in range(random.randint(0, 90)))) for i in range(40)]
    rows += [(6000, "x " * 100), (6001, "x " * 19), (6002, None), (6003, ""), (6004, "q w " * 30), (6000, "y " * 70), (6000, "x " * 100)]
    random.shuffle(rows)
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == slow_cut(rows)


def test_substring_positions_are_wide():
    # two windows far beyond 2**26 words: the places hold them
    at = (1 << 34) - 7
    place = at << substring._COUNT | 16
    assert place >> substring._COUNT == at and place & 31 == 16


def test_substring_without_ids(spark):
    texts = [f"{i} " + " ".join(f"w{j}" for j in range(25)) for i in range(6)]
    rows = [(None, t) for t in texts] + [(3, texts[0]), (3, "y " * 30)]
    got = Counter((r.doc_id, r.n_removed) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 0): 6, (3, 25 + 1): 1, (3, 28 + 2 - 20): 0} or got[(None, 0)] == 6 and got[(3, 26)] == 1


def test_substring_odd_rows(docs, no_docs):
    got = substring.deduplicate(docs).collect()
    assert len(got) == 10
    assert {(r.n_words, r.n_removed) for r in got if r.doc_id == 6} == {(12000, 11998)}
    assert substring.deduplicate(no_docs).count() == 0


# ---- toxicity -----------------------------------------------------------------------------------
def toxic_tables(spark, n=600):
    random.seed(11)
    words = [a + b + c for a in "ka lo mi ru te".split() for b in "n s r l".split() for c in "a e o".split()]
    docs, labels = [], []
    for i in range(n):
        w = [random.choice(words) for _ in range(random.randint(20, 120))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            w.insert(random.randrange(len(w)), random.choice(TOXIC))
        docs.append((i, " ".join(w)))
        if i % 5 < 3:
            labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.predictions(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    rejected, toxic = {r.doc_id for r in held if r.predicted}, {r.doc_id for r in held if r.doc_id % 6 == 0}
    assert not rejected - toxic and len(rejected) >= 0.9 * len(toxic)
    assert toxicity.keep_clean(docs, labels).count() == sum(r.predicted == 0 for r in got)


def test_risk_and_its_gradient():
    np = toxicity.np
    rng = np.random.default_rng(5)
    dense = [(rng.random((n, 7)) < 0.4) * rng.random((n, 7)) for n in (9, 14)]
    sparse = [toxicity._Rows(*np.nonzero(x), x[np.nonzero(x)], np.ones(len(x), bool), 7) for x in dense]
    prior, theta = 0.2, rng.normal(size=8)

    def parts(theta):
        zp, zu = (x @ theta[:7] + theta[7] for x in dense)
        loss = lambda z: np.log(1 + np.exp(-z)).mean()
        return prior * loss(zp), loss(-zu) - prior * loss(-zp)

    plus, bracket, grad_plus, grad_bracket = toxicity.risk(*sparse, prior, theta)
    assert np.allclose((plus, bracket), parts(theta))
    for part, grad in ((0, grad_plus), (1, grad_bracket)):
        slow = [(parts(theta + e)[part] - parts(theta - e)[part]) / 2e-6 for e in np.eye(8) * 1e-6]
        assert np.allclose(grad, slow, atol=1e-6)
    # few positives, and a bracket that turns negative: the step ascends it, so the fit stays finite
    weights, bias = toxicity.nnpu(*sparse, 0.6, steps=50)
    assert np.isfinite(weights).all() and np.isfinite(bias)


def test_toxicity_features_are_the_documented_ones(spark):
    np = toxicity.np
    docs, labels = toxic_tables(spark, 300)
    texts, told = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    learning = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    model = toxicity.train(docs, labels)
    count, words = Counter(), 0
    for t in learning.values():
        for w in t.lower().split():
            words += 1
            count.update(toxicity.features(w))
    has = lambda i: {f for w in texts[i].lower().split() for f in toxicity.features(w)}
    sides = [[has(i) for i, y in told.items() if i in learning and (y == 1 or not side)] for side in (1, 0)]
    want = []
    for f in set().union(*sides[1]):
        p, u = (sum(f in h for h in s) for s in sides)
        pooled = (p + u) / (len(sides[0]) + len(sides[1]))
        z = (p / len(sides[0]) - u / len(sides[1])) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / len(sides[0]) + 1 / len(sides[1])))
        if p >= 2 and z > toxicity.SIGNIFICANT:
            want.append(f)
    assert [*model.chosen] == sorted(want)
    assert np.allclose(model.background, [count[f] / words for f in model.chosen])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i in list(texts)[:50]:
        c = Counter(f for w in texts[i].lower().split() for f in toxicity.features(w))
        z = model.bias + sum(model.weights[j] * math.log2(1 + c[f] / (1 + len(texts[i].split()) * model.background[j])) for f, j in model.chosen.items())
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert toxicity.predictions(docs, labels, max_positive=10, max_unlabelled=40).count() == 300


def test_keep_clean_odd_rows(spark, docs, no_docs):
    _, labels = toxic_tables(spark)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 10 and {r["a.b"] for r in kept.collect()} == {"dot"}
    assert toxicity.keep_clean(no_docs, labels).count() == 0


def test_toxicity_odd_rows(spark, docs, no_docs):
    _, labels = toxic_tables(spark)
    none = labels.where("false")
    for d in (docs, no_docs):
        got = toxicity.predictions(d, none).collect()
        assert len(got) == d.count() and all(r.predicted == 0 for r in got)
    twice = labels.unionByName(labels).withColumnRenamed("toxic", "toxic")
    assert toxicity.predictions(docs, twice).count() == 10
    assert toxicity.keep_clean(docs, none).columns == docs.columns


# ---- context-tree weighting ---------------------------------------------------------------------
def slow_ctw(learning, asked, depth):
    """log10 probability of the last byte of each asked sequence, by the recursion of the definition on plain counts."""
    count = Counter()
    for g in learning:  # bytes: context and symbol
        for d in range(depth + 1):
            for j in range(8):
                count[g[depth - d : depth], g[-1] >> (8 - j), j, g[-1] >> (7 - j) & 1] += 1
    seen = {}
    for c, prefix, j, _ in count:
        seen.setdefault((c[1:], prefix, j), set()).add(c) if c else None

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def tally(c, prefix, j):
        return count[c, prefix, j, 0], count[c, prefix, j, 1]

    def weighted(c, prefix, j):
        a, b = tally(c, prefix, j)
        if len(c) == depth:
            return kt(a, b)
        below = sum(weighted(x, prefix, j) for x in seen.get((c, prefix, j), ()))
        return math.log(0.5) + math.log(math.exp(kt(a, b)) + math.exp(below))

    out = []
    for g in asked:
        total = 0.0
        for j in range(8):
            prefix, bit, p = g[-1] >> (8 - j), g[-1] >> (7 - j) & 1, None
            for d in range(depth, -1, -1):
                c = g[depth - d : depth]
                a, b = tally(c, prefix, j)
                if a + b == 0:
                    p = None
                    continue
                own = (b + 0.5 if bit else a + 0.5) / (a + b + 1)
                if d == depth:
                    p = own
                    continue
                share = math.exp(kt(a, b) + math.log(0.5) - weighted(c, prefix, j))
                # a context without a node: its estimate before any symbol
                p = share * own + (1 - share) * (0.5 if p is None else p)
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_ctw_mixture_matches_the_definition(spark):
    texts = ["abracadabra", "a cat a cat", "abba", "the cat", "", "zoo"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.score for r in ctw.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = lambda t: [(b"\n" * 5 + t.encode() + b"\n")[i : i + 6] for i in range(len(t) + 1)]
    learning = [g for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for g in cut(t)]
    for i, t in rows:
        assert math.isclose(got[i], sum(slow_ctw(learning, cut(t), ctw.DEPTH)), rel_tol=1e-6), t


def test_ctw_base_and_code_length(spark):
    rows = [(i, t) for i, t, _ in random_docs(80, 5)] + [(900, None), (901, ""), (902, "Never SEEN")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scores(docs).collect()}
    tokens = lambda t: [*ctw.words(t), None]
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        r, base = got[i], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert abs(r.base_score - base) < 1e-6 and r.n_tokens == len(tokens(t)) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in tokens(t)) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.score < 0 and math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len(b" ".join(ctw.words(t))) + 1))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.n_tokens for r in held) * -4


def test_ctw_same_in_any_blocks(spark):
    rows = [(i, t) for i, t, _ in random_docs(60, 6)] + [(900, "long text of words " * 400), (901, "x" * 5000), (902, " " * 3000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = lambda **sizes: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in ctw.scores(docs, **sizes).collect())
    assert found(block_bytes=100, slot_bytes=2000) == found()


def test_ctw_long_texts_come_in_runs(monkeypatch):
    texts = ["", "a b", "long text of words " * 40, "x" * 500, " " * 300 + "End"]
    clean = [b" ".join(ctw.words(t)) + b"\n" for t in texts]
    want = ctw.grams(clean)[0]
    monkeypatch.setattr(ctw, "_CHUNK", 64)
    assert [[w for run in ctw._word_runs(t) for w in run] for t in texts] == [ctw.words(t) for t in texts]
    runs = list(ctw._gram_runs(clean))
    assert max(len(g) for g, _, _ in runs) <= 64 and (ctw.np.concatenate([g for g, _, _ in runs]) == want).all()
    assert Counter({i: n for i, n in enumerate(map(len, clean))}) == sum((Counter(dict(Counter(ctw.np.repeat(o, s).tolist()))) for _, s, o in runs), Counter())


def test_ctw_is_a_probability():
    import numpy as np

    g, _ = ctw.grams([b"abracadabra the cat\n", b"abba\n"])
    gram, n = np.unique(g, return_counts=True)
    levels = []
    for d in range(ctw.DEPTH + 1):
        short, back = np.unique(gram & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((short, np.bincount(back, n).astype(np.int64)))
    for cut in (0, 1):  # also with rare sequences left out
        tree = ctw.Tree([(s[c > cut], c[c > cut]) for s, c in levels])
        for context in (b"\n\n\n\n\n", b"cadab", b"zzzzz"):
            prefix = int.from_bytes(context, "big")
            assert abs((10 ** tree.log10(np.array([prefix << 8 | b for b in range(256)]))).sum() - 1) < 1e-6


def test_ctw_keeps_every_sequence(spark):
    import numpy as np

    random.seed(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, " ".join("".join(random.choices(letters, k=random.randint(3, 12))) for _ in range(1000))) for i in range(100)]
    rows += [(200 + i, rows[i][1][: 40 * i]) for i in range(20)]
    clean = lambda t: b" ".join(ctw.words(t)) + b"\n"
    learning = [clean(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    gram, n = np.unique(ctw.grams(learning)[0], return_counts=True)
    assert len(gram) > 500_000  # nearly all seen once
    levels = []
    for d in range(ctw.DEPTH + 1):
        short, back = np.unique(gram & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((short, np.bincount(back, n).astype(np.int64)))
    whole = ctw.Tree(levels)
    got = {r.doc_id: r.score for r in ctw.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert math.isclose(got[i], whole.log10(ctw.grams([clean(t)])[0]).sum(), rel_tol=1e-6), i


def test_ctw_odd_rows(docs, no_docs):
    got = ctw.scores(docs).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert ctw.scores(no_docs).count() == 0


# ---- BPE ----------------------------------------------------------------------------------------
def test_bpe_is_the_library(spark, docs, no_docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    random.seed(1)
    texts = ["", "   ", "a" * 3000, "aaa aaaa aaaaa", "It's I'LL we'Re 'S", "<|endoftext|>x<|startoftext|> <|endoftext|", "ΣΑΣ ΌΣΟΣ İstanbul ß", "x\x1cy\x85z​q", "日本語 １２３ ①½", "👩‍👩‍👧 ok", None]
    texts += ["".join(random.choice("aAbé'sStd 1²\t\n ñΣς-_.<|>漢") for _ in range(random.randint(1, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {r.doc_id: r.ids for r in bpe.encode(rows).collect()}
    for r in bpe.encode_digests(rows).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert ids[r.doc_id] == want and r.n_tokens == len(want)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))
    assert bpe.encode_digests(docs).count() == 10 and bpe.encode_digests(no_docs).count() == 0


# ---- PII ----------------------------------------------------------------------------------------
def slow_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def slow_found(rows):
    """Spans of every row by the documented rules, with the bootstrap over plain dictionaries."""
    token = re.compile(r"[^\x20\x09-\x0D]+")
    spots, told = [], {}
    for i, t in rows:
        told[i] = [(k, s, e) for k, s, e in slow_spans(t or "")]
        words = [(m.start(), m.end()) for m in token.finditer(t or "")]
        places = [(s, e, pii.KINDS.index(k)) for k, s, e in told[i]]
        for s, e in words:
            inner = re.match(r"(?s)^[^0-9A-Za-z+]*([0-9A-Za-z+].*?)[^0-9A-Za-z]*$", t[s:e])
            if not inner:
                continue
            x, y = s + inner.start(1), s + inner.end(1)
            if (sum(c.isascii() and c.isdigit() for c in t[x:y]) >= 4 or t[x:y].find("@") > 0) and not any(a < y and x < b for _, a, b in told[i]):
                places.append((x, y, None))
        for s, e, k in places:
            before, after = token.findall(t[:s]), re.match(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", t[e:])
            shape = lambda w: re.sub("[0-9]+", "9", w.lower())
            ps = {f"L {shape(' '.join(before[-2:]))}"} if len(before) > 1 else set()
            if before and after:
                ps.add(f"A {shape(before[-1])} _ {shape(after[1])}")
            spots.append((i, s, e, k, t[s:e].lower(), ps))
    seed = {}
    for _, _, _, k, v, ps in spots:
        if k is not None and ps:
            seed[v] = max(k, seed.get(v, -1))
    known, edges = dict(seed), {(p, v) for *_, v, ps in spots for p in ps}
    while True:
        best = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            kinds = Counter(known[v] for v in values if v in known)
            if sum(kinds.values()) >= pii.SUPPORT and sum(kinds.values()) >= pii.CONFIDENCE * len(values):
                best[p] = (sum(kinds.values()) / len(values), -min(kinds, key=lambda k: (-kinds[k], k)))
        news = {}
        for p, v in edges:
            if p in best and v not in known:
                news[v] = max(best[p], news.get(v, best[p]))
        if not news:
            break
        known |= {v: -b[1] for v, b in news.items()}
    for i, s, e, k, v, _ in spots:
        if k is None and v in known and v not in seed:
            told[i].append((pii.KINDS[known[v]], s, e))
    return {i: sorted(set(x), key=lambda x: (pii.KINDS.index(x[0]), *x[1:])) for i, x in told.items()}


def test_pii_base_and_discovery(spark):
    random.seed(3)
    rows = [(i, "".join(random.choice("a1.9@ +-()b_%é😀\n50 4") for _ in range(random.randint(0, 80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 0001.2.3.4 a" * 30), (1003, "a" * 20000 + "@"), (1004, "1" * 9000), (1005, "+1" + " " * 5000 + "2345678901"), (1006, "😀 x@y.zz 4111 1111 1111 1111")]
    rows += [(2000 + i, f"Bitte meine Kennung: {f'u{i}@x.org' if i < 5 else f'ZX-99{i}71'} ende.") for i in range(8)]
    # texts of many pieces, cut at every kind of place: long words, runs of blanks, numbers, lists of phones and addresses
    bits = ["word ", "ende. ", "\n", "   ", "1.2.3.4 ", "10.20.30.40\t", "+49 30 1234567 ", "4111 1111 1111 1111 ", "12345 ", "jo@x.org ", "Kennung: ZX-99571 ende. ", "é😀 ", "é" * 150 + " ", "w" * 1500 + " ", "9" * 40 + " ", "(+1)-(2) ", "\x0b"]
    rows += [(3000 + i, "".join(random.choice(bits) for _ in range(random.randint(200, 900)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    found = slow_found(rows)
    for i, t in rows:
        want, r = slow_spans(t or ""), got[i]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in found[i])
    assert [got[2000 + i].spans for i in range(5, 8)] == ["email:21:29"] * 3
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert {clean[2000 + i] for i in range(8)} == {"Bitte meine Kennung: [EMAIL] ende."}
    for i, t in rows:
        out, at = [], 0
        for k, s, e in sorted(found[i], key=lambda x: (x[1], x[2], pii.KINDS.index(x[0]))):
            if s >= at:
                out += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        assert clean[i] == (t if t is None else "".join(out) + t[at:])


def test_pii_of_texts_with_many_matches(spark):
    lists = ["a1@b.co ", "a12345b ", "1.2.3.4 ", "+49 30 1234567 ", "12345 "]
    rows = [(i, x * 10000) for i, x in enumerate(lists)] + [(10 + i, x * 10000) for i, x in enumerate(lists)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.monotonic() - began < 240
    for i, t in rows:
        want = slow_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), i
    assert clean[0] == clean[10] == "[EMAIL] " * 10000 and clean[2] == "[IP] " * 10000


def test_pii_discovery_follows_long_chains(spark):
    seeds, steps = [f"seed{i}" for i in range(5)], 7
    found = lambda i: [f"v{i}-{j}" for j in range(3)] if i else seeds[2:]
    rows = [(v, 0 if v in seeds else None, f"p{i}") for i in range(steps) for v in (*seeds[:2], *found(i), *found(i + 1))]
    got = pii.bootstrap(spark.createDataFrame(rows, "value string, k int, p string")).collect()
    assert {(r.value, r.k) for r in got} == {(v, 0) for i in range(steps) for v in found(i + 1)}


def test_pii_odd_rows(docs, no_docs):
    assert pii.span_digests(docs).count() == 10 and pii.span_digests(no_docs).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.where("doc_id = 4").collect()} == {"The quick brown fox, write to [EMAIL]"}
    assert {(r.base, r["a.b"], r.extra, r.cuts) for r in clean.collect()} == {("b", "dot", "x", "c")}
    found = pii.find_spans(docs)
    assert found.columns == [c for c in docs.columns if c not in ("base", "spans")] + ["base", "spans"] and found.count() == 10
