"""The best rows by BM25 of many requests, block of rows by block, where totals are not asked.

A request meets all rows of a block in one task, which keeps its best; so what is shuffled are the
best rows of each block, not every row that shares a term with a request. Requests are read past each
block from the shared folder. Terms are 64-bit hashes here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.functions import text as T
from lessonlake.operators import retrieval as R
from lessonlake.sources.shared import filesystem, materialize, qualified, shared_path

#: Rows of a block; requests that are read together.
_ROWS, _ASKED = 16384, 2048
_FOUND = "query_id {0}, id string, score double, shared int, size int"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each list begins, the end included."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


class _Block:
    """Postings of the asked terms in a block, and the token sets of its rows."""

    def __init__(self, rows: pa.Table, asked: np.ndarray, weights: tuple[float, ...], avg_d: float) -> None:
        self.ids = np.array(rows.column("id").to_pylist(), object)
        # places in the order of the ids, so that ties end in the id
        self.order = np.argsort(np.argsort(self.ids))
        self.group = np.array(rows.column("grp").to_pylist(), object)
        terms, docs, tf = [], [], []
        for i, w in enumerate(weights):
            h, cuts = _flat(rows.column(f"c{i}"))
            at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
            hit = asked[at] == h
            terms.append(at[hit])
            docs.append(np.repeat(np.arange(len(self.ids)), np.diff(cuts))[hit])
            tf.append(np.full(hit.sum(), w))
        key, back = np.unique(np.concatenate(terms) * len(self.ids) + np.concatenate(docs), return_inverse=True)
        tf, (term, self.doc) = np.bincount(back, np.concatenate(tf), len(key)), np.divmod(key, len(self.ids))
        d = rows.column("d").to_numpy().astype(float)
        self.part = tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * d[self.doc] / avg_d))
        self.cuts = np.searchsorted(term, np.arange(len(asked) + 1))
        self.tokens, self.token_cuts = _flat(rows.column("tokens"))
        self.acc = np.zeros(len(self.ids))

    def _allowed(self, group: object, own: object) -> np.ndarray:
        at = np.flatnonzero(self.acc > 0)
        if own is not None:
            at = at[self.ids[at] != own]
        return at if group is None else at[self.group[at] == group]

    def best(self, terms: np.ndarray, idf: np.ndarray, most: int, group: object, own: object) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``most`` rows, by score rounded to 9 digits and id; ``own`` and other groups than ``group`` are left out.

        Terms go by rarity. Once the rest of them cannot lift a row over the last of the best so far, the
        rows that it can are looked up in the rest, which hold most places.
        """
        order = np.argsort(-idf, kind="stable")
        terms, idf = terms[order].tolist(), idf[order]
        rest, idf = np.cumsum(idf[::-1])[::-1] * (R.K1 + 1), idf.tolist()
        self.acc[:] = 0
        at = None
        for i, (k, w) in enumerate(zip(terms, idf, strict=True)):
            a, b = self.cuts[k], self.cuts[k + 1]
            if at is None and (b - a) * 32 > len(self.ids) and rest[i] < self.acc.max():
                some = self._allowed(group, own)
                if len(some) >= most:
                    value = self.acc[some]
                    least = np.partition(value, len(some) - most)[len(some) - most] - rest[i] - 1e-8
                    if least > 0:
                        at = some[value >= least]
            if at is None:
                self.acc[self.doc[a:b]] += w * self.part[a:b]
            elif a < b:
                docs = self.doc[a:b]
                place = np.minimum(np.searchsorted(docs, at), b - a - 1)
                self.acc[at] += np.where(docs[place] == at, w * self.part[a:b][place], 0)
        at = self._allowed(group, own) if at is None else at
        if len(at) > most:
            value = self.acc[at]
            at = at[value >= np.partition(value, len(at) - most)[len(at) - most] - 2e-9]
        at = at[np.lexsort((self.order[at], -np.round(self.acc[at], 9)))][:most]
        return at, -self.acc[at]


def _search(asked: str, terms: str, weights: tuple[float, ...], avg_d: float, most: int, kind: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        known = None
        held, size = [], 0

        def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(pa.Table.from_batches(held), known, weights, avg_d)
            fs, path = filesystem(asked)
            for q in dataset.dataset(path, format="parquet", filesystem=fs).to_batches(batch_size=_ASKED):
                term, cuts = _flat(q.column("terms"))
                idf, _ = _flat(q.column("idf"))
                mine, mine_cuts = _flat(q.column("tokens"))
                term = np.searchsorted(known, term)
                out = [[], [], [], [], []]
                for i, (qid, group, own) in enumerate(zip(*(q.column(c).to_pylist() for c in ("query_id", "grp", "own")), strict=True)):
                    at, score = block.best(term[cuts[i] : cuts[i + 1]], idf[cuts[i] : cuts[i + 1]], most, group, own)
                    if not len(at):
                        continue
                    wanted = np.sort(mine[mine_cuts[i] : mine_cuts[i + 1]])
                    lens = block.token_cuts[at + 1] - block.token_cuts[at]
                    theirs = np.concatenate([block.tokens[block.token_cuts[x] : block.token_cuts[x + 1]] for x in at])
                    place = np.minimum(np.searchsorted(wanted, theirs), max(len(wanted) - 1, 0))
                    hit = wanted[place] == theirs if len(wanted) else np.zeros(len(theirs), bool)
                    shared = np.bincount(np.repeat(np.arange(len(at)), lens)[hit], minlength=len(at))
                    for column, values in zip(out, ([qid] * len(at), block.ids[at].tolist(), score.tolist(), shared.tolist(), lens.tolist()), strict=True):
                        column.extend(values)
                if out[0]:
                    kinds = (pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["query_id", "id", "score", "shared", "size"])

        for b in batches:
            if known is None:
                fs, path = filesystem(terms)
                known = np.sort(dataset.dataset(path, format="parquet", filesystem=fs).to_table().column("term").to_numpy())
            if not len(known):
                return
            held.append(b)
            size += b.num_rows
            if size >= _ROWS:
                yield from answers(held)
                held, size = [], 0
        if held and size:
            yield from answers(held)

    return search


def best(phrases: DataFrame, mine: DataFrame, rows: DataFrame, theirs: object, index: R.Index, weights: tuple[float, ...], most: int) -> DataFrame:
    """(query_id, id, bm25_rank, score, shared, size, mine): the best ``most`` rows of each request of ``phrases`` (query_id, piece, times, tokens).

    ``mine`` has query_id, tokens (what is compared with the rows' ``theirs``), grp (rows of other
    groups are left out; null: none are) and own (an id that is left out; null: none is). ``shared`` is
    the number of tokens in common, ``size`` and ``mine`` those of the row and of the request.
    """
    asked = phrases.select("query_id", "times", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("run"))
    asked = materialize(asked.groupBy("query_id", "run", "n").agg(F.sum("times").alias("times")), "asked-runs")
    lengths = sorted(r[0] for r in asked.select("n").distinct().collect()) or [1]
    # a run counts once for each row
    found = None
    for n in lengths:
        runs = F.array_distinct(F.flatten(F.transform("cells", lambda c: R._runs(c, n))))  # noqa: B023
        here = index.rows.select(F.explode(runs).alias("run"))
        if n > 1:
            here = here.join(materialize(asked.where(F.col("n") == n).select("run").distinct(), "runs"), "run", "left_semi")
        here = here.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
        found = here if found is None else found.unionByName(here)
    df = found.join(asked.select("run").distinct(), "run", "left_semi")
    n, avg_d = index.totals.first()
    raw = F.log((F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = materialize(df.select("run", F.when(raw <= 0, R.LEAST_IDF).otherwise(raw).alias("idf")), "idf")
    told = asked.join(idf, "run").groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("run").alias("t"), (F.col("idf") * F.col("times")).alias("w"))).alias("x"))
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    requests = told.join(mine.select("query_id", hashed(F.col("tokens")).alias("tokens"), "grp", "own"), "query_id")
    requests, asked_at = _put(requests.select("query_id", F.col("x.t").alias("terms"), F.col("x.w").alias("idf"), "tokens", "grp", "own"), "block-requests")
    _, terms_at = _put(idf.select(F.xxhash64("run").alias("term")).distinct(), "block-terms")
    # a variable of the lambda, or each run would make the tokens anew
    runs_of = lambda t: F.flatten(F.transform(F.array(t), lambda x: F.flatten(F.array(*[hashed(R._runs(x, n)) for n in lengths]))))
    cells = [runs_of(R.tokenize(F.coalesce(F.col(c), F.lit("")), index.extra)).alias(f"c{i}") for i, c in enumerate(R.COLUMNS)]
    d = sum((F.size(R.tokenize(F.coalesce(F.col(c), F.lit("")), index.extra)) for c in R.COLUMNS), F.lit(0))
    block = rows.select("id", F.concat_ws("|", "task_type", "kind").alias("grp"), d.cast("long").alias("d"), hashed(theirs).alias("tokens"), *cells)
    kind = dict(requests.dtypes)["query_id"]
    top = block.mapInArrow(_search(asked_at, terms_at, weights, float(avg_d or 1), most, kind), _FOUND.format(kind))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    top = materialize(top.withColumn("bm25_rank", F.row_number().over(by).cast("long")).where(F.col("bm25_rank") <= most), "best-rows")
    return top.join(requests.select("query_id", F.size("tokens").alias("mine")), "query_id")


def _put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize`` with the qualified path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), qualified(df.sparkSession, path)
