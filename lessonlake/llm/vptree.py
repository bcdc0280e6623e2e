"""Approximate nearest neighbours: vantage-point trees per shard.

A shard's tree splits its rows at the median distance from a vantage point. A query leaves out a
side only if the triangle inequality, with the k-th best distance so far multiplied by ``factor``,
shows that nothing nearer is there: factor 1 gives the exact result, smaller factors prune more.
All queries of a block walk the tree together: first each to the leaf it belongs to, which gives a
distance to prune with, then once over all nodes, each with the queries that still need it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lessonlake.llm.cells import block_search, usable

LEAF = 128
#: How far pruning is relaxed where nothing else is asked for; README.md has the recall.
FACTOR = 0.7
#: Relative slack for the rounding of distances in pruning tests.
_SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to the same row of ``b``, summed in the order of the dimensions."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        diff = a[:, d] - b[:, d]
        total += diff * diff
    return np.sqrt(total)


class VpTree:
    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.v, self.squares = ids, v, np.einsum("ij,ij->i", v, v)
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> tuple:
        if len(rows) <= leaf:
            return (rows,)  # named by its first row
        # of a few spread rows, the one with the widest distances splits best
        tries = rows[np.linspace(0, len(rows) - 1, 5).astype(int)]
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.stack([np.linalg.norm(self.v[rows] - self.v[t], axis=1) for t in tries])
            best = int(np.argmax(np.nan_to_num(far.std(axis=1))))
        radius = float(np.median(far[best]))
        inside = far[best] <= radius
        if inside.all():  # many copies: no radius splits them
            inside = far[best] < radius
            if not inside.any():
                return (rows,)
            radius = float(far[best][inside].max())
        return (tries[best], radius, self._build(rows[inside], leaf), self._build(rows[~inside], leaf))

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, distance) of each query's best ``k`` rows but its own id."""
        self.near = np.full((len(q), k), np.inf)
        self.who, self.there = np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k), bool)
        with np.errstate(over="ignore", invalid="ignore"):
            self.home = np.full(len(q), -1)
            self._descend(self.root, np.arange(len(q)), qids, q, k)
            self._sweep(self.root, np.arange(len(q)), qids, q, k, factor)
        at, slot = np.nonzero(self.there)
        return at, self.who[at, slot], self.near[at, slot]

    def _visit(self, rows: np.ndarray, mine: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> None:
        """Offer ``rows`` to the queries ``mine``; a matrix product, with slack, tells which pairs are worth an exact distance."""
        scale = self.squares[rows][None, :] + np.einsum("ij,ij->i", q[mine], q[mine])[:, None]
        square = scale - 2 * (q[mine] @ self.v[rows].T)
        # a distance beyond the numbers is infinite; where sums are no numbers the pair is worth it
        worth = ~(square > self.near[mine, -1][:, None] ** 2 + _SLACK * scale) & (self.ids[rows][None, :] != qids[mine][:, None])
        some = np.flatnonzero(worth.any(axis=1))
        if not len(some):
            return
        worth, mine = worth[some], mine[some]
        i, j = np.nonzero(worth)
        d = np.full(worth.shape, np.inf)
        d[i, j] = distances(q[mine[i]], self.v[rows[j]])
        join = lambda old, new: np.hstack([old[mine], np.broadcast_to(new, worth.shape)])
        d, ids, there = join(self.near, d), join(self.who, self.ids[rows]), join(self.there, worth)
        order = np.lexsort((ids, d, ~there), axis=1)[:, :k]
        self.near[mine], self.who[mine], self.there[mine] = (np.take_along_axis(x, order, 1) for x in (d, ids, there))

    def _leaf(self, rows: np.ndarray, mine: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> None:
        for at in range(0, len(rows), 512):
            self._visit(rows[at : at + 512], mine, qids, q, k)

    def _descend(self, node: tuple, mine: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> None:
        if not len(mine):
            return
        if len(node) == 1:
            self.home[mine] = node[0][0]
            self._leaf(node[0], mine, qids, q, k)
            return
        point, radius, inner, outer = node
        close = np.linalg.norm(q[mine] - self.v[point], axis=1) <= radius
        self._descend(inner, mine[close], qids, q, k)
        self._descend(outer, mine[~close], qids, q, k)

    def _sweep(self, node: tuple, mine: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, factor: float) -> None:
        if not len(mine):
            return
        if len(node) == 1:
            self._leaf(node[0], mine[self.home[mine] != node[0][0]], qids, q, k)
            return
        point, radius, inner, outer = node
        d = np.linalg.norm(q[mine] - self.v[point], axis=1)
        reach = lambda: self.near[mine, -1] * factor + _SLACK * (1 + radius)
        self._sweep(inner, mine[~(d - reach() > radius)], qids, q, k, factor)
        self._sweep(outer, mine[~(d + reach() < radius)], qids, q, k, factor)


def nearest(vectors: DataFrame, modulus: int = 100, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest other rows found for every query, by Euclidean distance.

    Queries are the rows whose vec_id ``modulus`` divides; every row is indexed. ``factor`` 1 finds the
    nearest rows for certain; the default prunes more. Vectors that are null, empty, zero, or hold
    null or non-finite components take no part, nor do rows without an id. Ties go to the smaller
    vec_id; rows that repeat a vec_id count once, with their first vector in order; vectors of another
    length than the query's are no candidates; fewer than ``k`` candidates give fewer rows; distances
    beyond the largest double are infinite; other columns are ignored; an empty table gives no rows.
    """

    def find(tree: VpTree, qids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tree.search(qids, q, k, factor)

    return block_search(usable(vectors, zero=False), modulus, k, "double", VpTree, find, descending=False)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
