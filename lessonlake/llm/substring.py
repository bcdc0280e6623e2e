"""Substring deduplication: seed and extend over winnowed anchors.

Every window of ``WINDOW`` words is seeded by one anchor inside it: of its ``GRAM``-word sequences,
that with the smallest hash, the first among equals. As the choice depends on the window's words
alone, equal windows have equal anchors at equal places. Neighbouring windows mostly share an anchor,
so a document has about one anchor occurrence for eight or nine words; an occurrence is extended
left and right over the words of all windows it seeds.

Only anchors that occur twice or more go on. Occurrences whose extended words are equal form a class:
all but the earliest are repeats over their whole extent. Between classes of the same anchor, the
extents differ somewhere, so the windows of the earliest member of each class are compared one by
one. Together this finds each window whose words start earlier, without any pair of documents: a
class or a window is compared with its earliest occurrence alone. Overlapping windows then merge into
maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm._shared import drop_table, materialize, texts

WINDOW = 20
GRAM = 5
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _ODD)
#: A place in a document as one long: word position, and number of windows in the lowest bits.
_COUNT = 5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a text, with two 64-bit hashes of any range of them."""

    def __init__(self, text: str | None) -> None:
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def hashed(self) -> Words:
        token = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, self.n)
        self.sums, self.powers = [], []
        for t, base, inverse in zip((token, _mix(token)), _ODD, _INVERSE, strict=True):
            power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(self.n, base))))
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(t * power[: self.n], dtype=np.uint64))))
            self.powers.append(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(self.n, inverse)))))
        return self

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[which][end] - self.sums[which][start]) * self.powers[which][start])

    def anchors(self) -> np.ndarray:
        """For each window, the position of its anchor."""
        at = np.arange(self.n - GRAM + 1)
        gram = self.hash(0, at, at + GRAM)
        span, need = 1, WINDOW - GRAM + 1
        while span < need:  # windows of doubling width; the left one wins ties
            step = min(span, need - span)
            left, right = at[: len(at) - step], at[step:]
            at = np.where(gram[left] <= gram[right], left, right)
            span += step
        return at

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, hash of the extended words, first window and number of windows of each occurrence."""
        at = self.anchors()
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(first, len(at)))
        p = at[first]
        extent = self.hash(1, first, first + count - 1 + WINDOW)
        place = ((p - first) * 64 + count).astype(np.uint64)
        return self.hash(0, p, p + GRAM), _mix(extent + place * _ODD[0]), first, count


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            out = []
            for text, doc, tag in zip(part.column("text").to_pylist(), part.column("doc").to_pylist(), part.column("tag").to_pylist(), strict=True):
                w = Words(text)
                if w.n >= WINDOW:
                    a, c, first, count = w.hashed().seeds()
                    out.append((a.view(np.int64), c.view(np.int64), np.full(len(a), doc), np.full(len(a), tag), first << _COUNT | count))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "c", "doc", "tag", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            out = []
            for text, doc, tag, places in zip(*(part.column(c).to_pylist() for c in ("text", "doc", "tag", "places")), strict=True):
                place = np.array(places, np.int64)
                first, count = place >> _COUNT, place & 31
                s = np.unique(np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                w = Words(text).hashed()
                out.append((w.hash(0, s, s + WINDOW).view(np.int64), w.hash(1, s, s + WINDOW).view(np.int64), np.full(len(s), doc), np.full(len(s), tag), s << _COUNT | 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "c", "doc", "tag", "place"])


def cut(text: str | None, places: list[int] | None) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, and the words that stay."""
    w = Words(text)
    if not places:
        return w.n, 0, w.words
    place = np.array(places, np.int64)
    first = place >> _COUNT
    edge = np.zeros(w.n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + (place & 31) - 1 + WINDOW, -1)
    stays = np.cumsum(edge[:-1]) == 0
    return w.n, int(w.n - stays.sum()), [x for x, s in zip(w.words, stays.tolist(), strict=True) if s]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = []
        for text, places in zip(texts(b), b.column("places"), strict=True):
            n, removed, kept = cut(text, places.as_py())
            done.append((n, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _, _ in done], pa.int64()), pa.array([r for _, r, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _start(place: str) -> Column:
    return F.shiftright(place, _COUNT)


def _earlier(doc: str, place: str) -> Column:
    """Whether the class's earliest member starts before this one."""
    return (F.col("first.doc") < F.col(doc)) | ((F.col("first.doc") == F.col(doc)) & (_start("first.place") < _start(place)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``doc`` (null ids as the smallest) and ``tag`` (tells apart texts that share an id)."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "tag": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tag, places) of every document with words to remove."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    row = "a long, c long, doc long, tag long, place long"
    spots = materialize(keyed.select("text", "doc", "tag").mapInArrow(_occurrences, row), "anchors")
    # written first: a join can split a hot key only where no aggregate stands between it and its shuffle
    by_anchor = spots.groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1")
    by_anchor = materialize(by_anchor, "repeated-anchors")
    shared = materialize(spots.join(by_anchor.select("a", "mixed"), "a"), "shared-anchors")
    drop_table(spots)

    earliest = F.min(F.struct("doc", "place", "tag")).alias("first")
    classes = materialize(shared.groupBy("a", "c", "mixed").agg(earliest, F.count(F.lit(1)).alias("n")).where("mixed OR n > 1"), "classes")
    copies = shared.drop("mixed").join(classes.where("n > 1").select("a", "c", "first"), ["a", "c"]).where(_earlier("doc", "place"))
    copies = materialize(copies.select("doc", "tag", "place"), "copied-spans")
    drop_table(shared)

    heads = classes.where("mixed").select("first.doc", "first.tag", "first.place")
    wanted = heads.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
    single = materialize(keyed.join(wanted, ["doc", "tag"]).select("text", "doc", "tag", "places").mapInArrow(_windows, row), "windows")
    first_of = single.groupBy("a", "c").agg(earliest, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first_of = materialize(first_of, "first-windows")
    more = single.join(first_of, ["a", "c"]).where(_earlier("doc", "place")).select("doc", "tag", "place")
    spans = copies.unionByName(more)
    return materialize(spans.groupBy("doc", "tag").agg(F.collect_set("place").alias("places")), "repeats")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    A word is removed if a window of ``WINDOW`` words that covers it also starts earlier: in a row of
    smaller doc_id, or in a row of the same doc_id at a smaller position. Windows are judged on the
    input. Null, empty and short texts have no window; rows that repeat a document whole are equal
    places and remove nothing from one another; rows of one doc_id with different texts are cut each
    by its own spans; rows without an id come first; other columns are ignored; an empty table gives
    no rows.
    """
    spans = repeats(docs)
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    joined = keyed.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cutter, "doc_id long, n_words long, n_removed long, kept_sha256 string")
