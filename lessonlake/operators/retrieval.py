"""Full-text retrieval: tokenizer, inverted index, phrase matching, BM25, and the searches on top.

All operators take a DataFrame of requests and answer them together. An index is four DataFrames;
statistics are corpus-wide, so filters apply after scoring. Every ranking ends in ``id``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.functions import text as T
from lessonlake.sources.shared import materialize

COLUMNS = ("title", "what", "learned", "tags")
#: Column weights: plain search, and the ones of browsing, near-duplicates and neighbours.
FLAT, WEIGHTED = (1.0, 1.0, 1.0, 1.0), (3.0, 1.0, 2.0, 1.0)
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CANDIDATES = 20

def _folds() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks with marks, and the letters they become: the base of their decomposition."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii() and base.isalpha():
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _folds()
#: Combining marks do not end a token and are dropped from it.
_MARKS = r"[\u0300-\u036f]+"


def tokenize(text: Column, extra: str = "_-") -> Column:
    """T1 without stemming: lower-cased letters and digits, marks folded; ``extra`` stay inside tokens."""
    inside = "".join("\\" + c for c in extra)
    folded = F.translate(F.regexp_replace(F.lower(text), _MARKS, ""), _MARKED, _PLAIN)
    return F.filter(F.split(folded, rf"[^\p{{L}}\p{{N}}{inside}]+"), lambda t: t != "")


@dataclass
class Index:
    """postings (id, col, pos, term), stats (id, d) and totals (one row: n, avg_d); without stems, cells (id, col, tokens); rows (id, cells)."""

    postings: DataFrame
    stats: DataFrame
    totals: DataFrame
    extra: str = "_-"
    stem: object = None
    cells: DataFrame | None = None
    rows: DataFrame | None = None


def build(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, extra: str = "_-", stem: object = None) -> Index:
    """The index of ``rows`` (id and text columns). ``stem`` maps a (term) DataFrame to (term, stem).

    One pass tokenises all columns into a written table, which everything else reads; only the
    distinct vocabulary is stemmed and joined back.
    """
    whole = rows.select("id", F.array(*[tokenize(F.coalesce(F.col(c), F.lit("")), extra) for c in columns]).alias("cells"))
    whole = materialize(whole, "index-cells")
    cells = whole.select("id", F.posexplode("cells").alias("col", "tokens"))
    stats = whole.groupBy("id").agg(F.sum(F.size(F.flatten("cells"))).cast("long").alias("d"))
    postings = cells.select("id", "col", F.posexplode("tokens").alias("pos", "term"))
    if stem is not None:
        stems = materialize(stem(postings.select("term").distinct()), "index-stems")
        postings = materialize(postings.join(stems, "term").select("id", "col", "pos", F.col("stem").alias("term")), "index-postings")
    totals = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg_d"))
    return Index(postings, stats, totals, extra, stem, None if stem else cells, whole)


def term_stats(index: Index) -> DataFrame:
    """Documents and occurrences of each term."""
    return index.postings.groupBy("term").agg(F.countDistinct("id").alias("df"), F.count(F.lit(1)).alias("cf"))


def query_phrases(requests: DataFrame, index: Index, text: str = "query") -> DataFrame:
    """(query_id, piece, tokens, times): a repeated piece scores as often as it stands there; pieces without tokens go."""
    pieces = requests.select("query_id", F.explode(T.phrases(F.col(text))).alias("piece"))
    pieces = pieces.groupBy("query_id", "piece").agg(F.count(F.lit(1)).alias("times"))
    return pieces.withColumn("tokens", tokenize(F.col("piece"), index.extra)).where(F.size("tokens") > 0)


def term_phrases(requests: DataFrame, terms: Column, extra: str = "_-") -> DataFrame:
    """Like ``query_phrases`` for requests that carry their own term lists."""
    return requests.select("query_id", F.explode(terms).alias("piece")).select("query_id", "piece", F.lit(1).cast("long").alias("times"), tokenize(F.col("piece"), extra).alias("tokens")).where(F.size("tokens") > 0)


def match(phrases: DataFrame, index: Index, weights: tuple[float, ...] = FLAT) -> DataFrame:
    """(piece, id, tf) of every phrase, tf weighted by column. Each distinct phrase is matched once for all requests.

    The phrases' tokens are a written table, so Spark knows its size and sends it to the postings where
    it is small. Phrases of one token need no position test and stay out of the grouping by position.
    """
    distinct = phrases.select("piece", "tokens").dropDuplicates(["piece"])
    if index.cells is not None:
        return _match_runs(distinct, index, weights)
    spots = distinct.select("piece", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "term"))
    if index.stem is not None:
        spots = spots.join(index.stem(spots.select("term").distinct()), "term").select("piece", "n", "at", F.col("stem").alias("term"))
    hits = index.postings.join(materialize(spots, "phrase-tokens"), "term")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("col") + 1)
    single = hits.where("n = 1").groupBy("piece", "id").agg(F.sum(weight).alias("tf"))
    runs = hits.where("n > 1").groupBy("piece", "id", "col", (F.col("pos") - F.col("at")).alias("start"), "n").agg(F.countDistinct("at").alias("got"))
    longer = runs.where("got = n").groupBy("piece", "id").agg(F.sum(weight).alias("tf"))
    return single.unionByName(longer)


def _runs(tokens: Column, n: int) -> Column:
    """The runs of ``n`` tokens, joined by spaces, which no token holds."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def _match_runs(distinct: DataFrame, index: Index, weights: tuple[float, ...]) -> DataFrame:
    """``match`` by whole runs: a phrase meets the places where all of its tokens stand, not those of each token.

    Pieces with the same tokens are matched once, and get their names last.
    """
    asked = materialize(distinct.select("piece", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("run")), "phrase-runs")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("col") + 1)
    found = None
    for (n,) in sorted(map(tuple, asked.select("n").distinct().collect())):
        runs = materialize(asked.where(F.col("n") == n).select("run").distinct(), "runs")
        here = index.cells.select("id", "col", F.explode(_runs(F.col("tokens"), n)).alias("run")).join(runs, "run")
        here = here.groupBy("run", "id").agg(F.sum(weight).alias("tf"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return asked.select("piece", F.lit(None).cast(index.cells.schema["id"].dataType).alias("id"), F.lit(0.0).alias("tf")).limit(0)
    return found.join(asked.select("piece", "run"), "run").select("piece", "id", "tf")


def bm25(phrases: DataFrame, index: Index, weights: tuple[float, ...] = FLAT) -> DataFrame:
    """T4: (query_id, id, score); scores are negative, lower is better."""
    hits = materialize(match(phrases, index, weights), "phrase-hits")
    df = hits.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    return score(hits.join(index.stats, "id"), df, index, phrases, "id")


def score(hits: DataFrame, df: DataFrame, index: Index, phrases: DataFrame, *of: str) -> DataFrame:
    """The sums of BM25 over hits (piece, tf, d and the columns ``of``) of each query."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("d") / F.col("avg_d"))
    # totals is one row
    scored = hits.join(df, "piece").join(F.broadcast(index.totals))
    scored = scored.select("piece", *of, (idf * F.col("tf") * (K1 + 1) / norm).alias("part"))
    asked = phrases.select("query_id", "piece", "times")
    return scored.join(asked, "piece").groupBy("query_id", *of).agg((-F.sum(F.col("part") * F.col("times"))).alias("score"))


def _rank(by: list, partition: str = "query_id") -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*by)).cast("long")


def pull(requests: DataFrame, memories: DataFrame, index: Index, limit: int = 5, weight: float = 2.0) -> DataFrame:
    """``search`` without filters and without ``total``: rows that cannot be among the best are not shuffled."""
    from lessonlake.operators import blocks

    limit = min(limit if limit > 0 else 5, 20)
    mine = requests.select("query_id", T.tokens(F.col("query")).alias("tokens"), F.lit(None).cast("string").alias("grp"), F.lit(None).cast("string").alias("own"))
    hits = blocks.best(query_phrases(requests, index), mine, memories, T.tokens(F.concat_ws(" ", "title", "learned")), index, FLAT, min(3 * limit, 60))
    hits = hits.withColumn("overlap", F.when(F.col("mine") == 0, 0.0).otherwise(F.col("shared") / F.col("mine")))
    hits = hits.withColumn("blend", T.composite(F.col("score"), F.col("overlap"), weight))
    hits = hits.withColumn("rank", _rank([F.round("blend", 9), "bm25_rank"])).where(F.col("rank") <= limit)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"))


def search(requests: DataFrame, memories: DataFrame, index: Index, limit: int = 5, weight: float = 2.0) -> DataFrame:
    """T5: per request, the best min(3 x limit, 60) by BM25, re-ranked with token overlap, cut to ``limit``.

    ``requests`` has query_id, query and optionally task_type and kind, which filter after scoring;
    ``total`` counts all filtered matches. Requests without tokens give no rows.
    """
    limit = min(limit if limit > 0 else 5, 20)
    fetch = min(3 * limit, 60)
    hits = bm25(query_phrases(requests, index), index).join(memories.select("id", "task_type", "kind"), "id")
    wanted = [c for c in ("task_type", "kind") if c in requests.columns]
    asked = requests.select("query_id", *[F.col(c).alias(f"want_{c}") for c in wanted])
    hits = hits.join(asked, "query_id")
    for c in wanted:
        hits = hits.where(F.col(f"want_{c}").isNull() | (F.col(c) == F.col(f"want_{c}")))
    hits = materialize(hits, "scored")
    total = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    # the rank alone, so that each task keeps its best rows before the shuffle
    hits = hits.withColumn("bm25_rank", _rank([F.round("score", 9), "id"])).where(F.col("bm25_rank") <= fetch).join(total, "query_id")
    hits = hits.join(memories.select("id", "title", "learned"), "id").join(requests.select("query_id", "query"), "query_id")
    shared = T.overlap(T.tokens(F.col("query")), T.tokens(F.concat_ws(" ", "title", "learned")))
    hits = hits.withColumn("overlap", shared).withColumn("blend", T.composite(F.col("score"), F.col("overlap"), weight))
    hits = hits.withColumn("rank", _rank([F.round("blend", 9), "bm25_rank"])).where(F.col("rank") <= limit)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"), "total")


def browse(requests: DataFrame, memories: DataFrame, index: Index, limit: int = 10) -> DataFrame:
    """Per request (query_id, query, task_type, kind), the best ``limit`` by weighted BM25 inside one task type and kind."""
    hits = bm25(query_phrases(requests, index), index, WEIGHTED).join(memories.select("id", "task_type", "kind"), "id")
    hits = hits.join(requests.select("query_id", "task_type", "kind"), ["query_id", "task_type", "kind"])
    hits = hits.withColumn("rank", _rank([F.round("score", 9), "id"])).where(F.col("rank") <= limit)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def browse_kinds(requests: DataFrame, memories: DataFrame, index: Index, kinds: tuple[str, ...], limit: int = 10) -> DataFrame:
    """Like ``browse`` for several kinds at once: phrases are scored once, and ranked inside each kind."""
    hits = bm25(query_phrases(requests, index), index, WEIGHTED).join(memories.where(F.col("kind").isin(*kinds)).select("id", "task_type", "kind"), "id")
    hits = hits.join(requests.select("query_id", "task_type"), ["query_id", "task_type"])
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.round("score", 9), "id")).cast("long")
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "kind", "rank", "id", F.round("score", 6).alias("score"))


def body(prefix: str = "") -> Column:
    return F.concat_ws(" ", *[prefix + c for c in COLUMNS])


def candidates(seeds: DataFrame, memories: DataFrame, index: Index, *, same_group: bool, most: int = CANDIDATES) -> DataFrame:
    """(query_id, id, bm25_rank, jaccard): the best ``most`` rows for each seed's capped terms, the seed left out."""
    from lessonlake.operators import blocks

    tokens = T.tokens(body())
    group = F.concat_ws("|", "task_type", "kind") if same_group else F.lit(None).cast("string")
    # written, so that the tokens are made once
    asked = materialize(seeds.select(F.col("id").alias("query_id"), tokens.alias("tokens"), group.alias("grp"), F.col("id").alias("own")), "seeds")
    phrases = term_phrases(asked, T.capped(F.col("tokens")), index.extra)
    top = blocks.best(phrases, asked, memories, tokens, index, WEIGHTED, most)
    jaccard = F.when((F.col("mine") == 0) | (F.col("size") == 0), 0.0).otherwise(F.col("shared") / (F.col("mine") + F.col("size") - F.col("shared")))
    return top.select("query_id", "id", "bm25_rank", jaccard.alias("jaccard"))


def nearest_duplicate(seeds: DataFrame, memories: DataFrame, index: Index) -> DataFrame:
    """The candidate of the highest Jaccard; the better BM25 rank wins ties."""
    found = candidates(seeds, memories, index, same_group=True)
    best = found.withColumn("r", _rank([F.col("jaccard").desc(), "bm25_rank"])).where("r = 1")
    return best.select(F.col("query_id").alias("seed_id"), "id", F.round("jaccard", 6).alias("jaccard"))


def neighbours(seeds: DataFrame, memories: DataFrame, index: Index, limit: int = 5) -> DataFrame:
    """The ``limit`` most similar of the best candidates in the whole corpus, with Jaccard over 0."""
    found = candidates(seeds, memories, index, same_group=False).where("jaccard > 0")
    ranked = found.withColumn("rank", _rank([F.col("jaccard").desc(), "bm25_rank"])).where(F.col("rank") <= limit)
    return ranked.select(F.col("query_id").alias("seed_id"), "rank", "id", F.round("jaccard", 6).alias("jaccard"))


def symbol_search(requests: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """The best ``limit`` symbols by BM25 over qname, name, doc and signature, whose tokens split at underscore, dot and hyphen."""
    index = build(symbols, ("qname", "name", "doc", "signature"), extra="")
    texts = requests.select(F.col("query").alias("query_id"), "query").distinct()
    found = best(term_phrases(texts, T.symbol_terms(F.col("query")), ""), index, limit).withColumnRenamed("query_id", "query")
    return requests.select("query_id", "query").join(found, "query").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def best(phrases: DataFrame, index: Index, limit: int) -> DataFrame:
    """(query_id, rank, id, score): the first ``limit`` of ``bm25`` for each query, where many rows match alike.

    Rows with the same phrases, as often, and the same length have one score: they are scored once for
    all, and only the first ``limit`` of them by id can be among the best.
    """
    hits = materialize(match(phrases, index), "phrase-hits")
    df = hits.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    alike = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "tf"))).alias("found")).join(index.stats, "id")
    alike = alike.withColumn("key", F.sha2(F.to_json(F.struct("found", "d")), 256))
    alike = materialize(alike.withColumn("r", _rank(["id"], "key")).where(F.col("r") <= limit), "alike")
    one = alike.where("r = 1").select("key", F.col("id").alias("first"), "d", F.explode("found").alias("f")).select("key", "first", "d", "f.piece", "f.tf")
    scores = score(one, df, index, phrases, "key", "first")
    near = scores.withColumn("r", _rank([F.round("score", 9), "first"])).where(F.col("r") <= limit).select("query_id", "key", "score")
    ranked = near.join(alike.select("key", "id"), "key").withColumn("rank", _rank([F.round("score", 9), "id"]))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")
