"""Exact top-k inner products over a bit-sliced index.

A block of quantised vectors is stored as bitmaps, one for each dimension and bit. A query's scores
are built as bitmaps too: for each bit of each of its components, that dimension's slices are added
at the bit's position with full adders over machine words (for a negative component the complement
is added, which differs by a constant of the query). The best rows are then selected from the most
significant slice downward; rows that are equal in all slices at the boundary are resolved by id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lessonlake.llm.cells import block_search, usable

SCALE = 256
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words, first row in the lowest bit."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


class BitSlices:
    """Slices of the columns of an integer matrix, each column shifted to start at 0."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, dims = x.shape
        self.low = x.min(axis=0)
        shifted = x - self.low
        self.width = [int(m).bit_length() for m in shifted.max(axis=0)]
        self.slices = [[pack((shifted[:, d] >> b & 1).astype(bool)) for b in range(self.width[d])] for d in range(dims)]
        self.rows = pack(np.ones(self.n, bool))

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score slices (lowest first) of shape (bits, queries, words), and the constant of each query."""
        size, below = np.abs(q), q < 0
        full = np.array([(1 << w) - 1 for w in self.width], np.int64)
        const = q @ self.low - (size * below) @ full
        bits = max(1, int((size @ full).max()).bit_length())
        acc = np.zeros((bits, len(q), len(self.rows)), np.uint64)
        for d, slices in enumerate(self.slices):
            flip = np.where(below[:, d], _ONES, np.uint64(0))[:, None]
            parts = [s ^ flip for s in slices]
            for j in range(int(size[:, d].max()).bit_length()):
                on = np.where(size[:, d] >> j & 1, _ONES, np.uint64(0))[:, None]
                carry = np.zeros_like(acc[0])
                for p in range(j, bits):
                    a = acc[p]
                    if p - j < len(parts):
                        s = parts[p - j] & on
                        half = a ^ s
                        s &= a
                        acc[p] = half ^ carry
                        half &= carry
                        carry = s | half
                    else:
                        if not carry.any():
                            break
                        acc[p], carry = a ^ carry, a & carry
        return acc, const

    def top(self, acc: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query position, row) of each query's best ``k`` rows; rows at ``own`` (-1: none) are left out, ties go to the first rows."""
        queries = acc.shape[1]
        maybe = np.repeat(self.rows[None, :], queries, axis=0)
        has = np.flatnonzero(own >= 0)
        maybe[has, own[has] // 64] &= ~(np.uint64(1) << (own[has] % 64).astype(np.uint64))
        sure = np.zeros_like(maybe)
        for s in acc[::-1]:
            high = maybe & s
            many = (np.bitwise_count(sure | high).sum(axis=1) > k)[:, None]
            sure = np.where(many, sure, sure | high)
            maybe = np.where(many, high, maybe & ~s)
        unpack = lambda words: np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        left = k - np.bitwise_count(sure).sum(axis=1).astype(np.int64)
        ties = unpack(maybe)
        ties &= np.cumsum(ties, axis=1, dtype=np.int32) <= left[:, None]
        return np.nonzero(unpack(sure) | ties)


class _Index:
    """The bit slices of one block, its integer vectors and their ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.floors = ids, np.floor(SCALE * v)
        self.most = np.abs(self.floors).max(axis=0)
        self.slices, self.x = None, None

    def whole(self) -> None:
        if self.slices is None:
            self.x = self.floors.astype(np.int64)
            self.slices = BitSlices(self.x)


def _exact(index: _Index, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows by whole numbers of any size; scores stop at the ends of a long."""
    x, out = [[int(c) for c in row] for row in index.floors], []
    for i, q in enumerate([[int(c) for c in row] for row in y]):
        scores = [sum(a * b for a, b in zip(q, row, strict=True)) for row in x]
        for at in sorted((j for j in range(len(x)) if j != own[i]), key=lambda j: (-scores[j], j))[:k]:
            out.append((i, at, max(-(1 << 63), min((1 << 63) - 1, scores[at]))))
    who, row, score = np.array(out, np.int64).reshape(-1, 3).T
    return who, index.ids[row], score


def _find(k: int):
    def find(index: _Index, qids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.floor(SCALE * q)
        at = np.minimum(np.searchsorted(index.ids, qids), len(index.ids) - 1)
        own = np.where(index.ids[at] == qids, at, -1)
        if 4 * float((index.most + 1) @ (np.abs(y).max(axis=0) + 1)) >= 2.0**62:  # sums might not fit a machine word
            return _exact(index, y, own, k)
        index.whole()
        y = y.astype(np.int64)
        acc, _ = index.slices.scores(y)
        who, row = index.slices.top(acc, k, own)
        return who, index.ids[row], np.einsum("ij,ij->i", index.x[row], y[who])

    return find


def top_k(vectors: DataFrame, modulus: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` largest integer inner products of every query with all other rows.

    Components are floor(256 x); queries are the rows whose vec_id ``modulus`` divides. Vectors that
    are null, empty, or hold null or non-finite components take no part, nor do rows without an id.
    Ties go to the smaller vec_id; rows that repeat a vec_id count once, with their first vector in
    order; vectors of another length than the query's are no candidates; fewer than ``k`` candidates
    give fewer rows; other columns are ignored; an empty table gives no rows. Where scores might not
    fit a long, they are added up as whole numbers of any size, and stop at the ends of a long.
    """
    return block_search(usable(vectors), modulus, k, "long", _Index, _find(k), descending=True)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
