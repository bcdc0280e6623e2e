"""Stated queries against all vectors: rows in blocks, one index a block, and all queries streamed past it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.llm._shared import filesystem, materialize, qualified, shared_path

#: Rows of a block at most, and rows that are worth a block where cores are idle.
ROW_BLOCK, LEAST_BLOCK = 32768, 2048
QUERY_BLOCK = 256


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, v (array of double) and dim; without vectors that are null, empty or hold null or non-finite components.

    ``zero=False`` also leaves out vectors of zeros alone. Rows without an id take no part.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    if not zero:
        v = v.where(F.exists("v", lambda x: x != 0))
    return v.withColumn("dim", F.size("v"))


def matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block by id; of rows with the same id, the first vector in order stays."""
    ids = table.column("vec_id").to_numpy()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    order = np.lexsort((*v.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, v = ids[order], v[order]
    keep = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
    return ids[keep], v[keep]


def _queries(folder: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of all queries of one length, a block at a time."""
    from pyarrow import dataset

    fs, root = filesystem(folder)
    found = dataset.dataset(root, filesystem=fs, format="parquet")
    for b in found.to_batches(filter=dataset.field("dim") == dim, columns=["vec_id", "v"], batch_size=QUERY_BLOCK):
        if b.num_rows:
            yield matrix(pa.Table.from_batches([b]), dim)


def block_search(vectors: DataFrame, modulus: int, k: int, kind: str, build: Callable, find: Callable, *, descending: bool) -> DataFrame:
    """query_id, rank, vec_id and score of the best ``k`` rows for every row whose id ``modulus`` divides.

    ``build(ids, rows)`` makes a block's index, once; ``find(index, query_ids, queries)`` gives (query
    position, id, score) of its best rows for one block of queries. Rows go to blocks by a hash of
    their id, so blocks are even whatever the ids or vectors are and a task's memory does not grow
    with the table. The queries are a written table that each block reads from the shared folder, so
    rows are shuffled once and queries never. Only vectors of one length meet; a rank needs a block's
    k best rows alone.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    folder = shared_path(spark, "queries")
    vectors.where(F.col("vec_id") % modulus == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).write.parquet(folder)
    folder, n = qualified(spark, folder), vectors.count()
    blocks = max(1, math.ceil(n / ROW_BLOCK), min(math.ceil(n / LEAST_BLOCK), 2 * spark.sparkContext.defaultParallelism))

    def search(key: tuple, mine: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        index = build(*matrix(mine, dim))
        for qids, q in _queries(folder, dim):
            at, ids, score = find(index, qids, q)
            found.append((qids[at], ids, score))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [[], [], []]
        kinds = pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.float64()
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query_id", "vec_id", "score"), columns, kinds, strict=True)})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    found = vectors.groupBy("dim", block.alias("block")).applyInArrow(search, f"query_id long, vec_id long, score {kind}")
    best = F.col("score").desc() if descending else F.col("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
