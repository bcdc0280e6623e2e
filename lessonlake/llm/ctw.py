"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision (the bits of the byte seen so far) has a context tree
over the preceding bytes, 0 to ``DEPTH`` of them. A node's Krichevsky-Trofimov estimate is mixed with
its children's mixture, with weights that follow from the block probabilities of the training text:

    Pw(node) = 1/2 Pkt(node) + 1/2 prod Pw(children)

Training text is what the learning documents hold: lower-cased words joined by one space, then an
end byte. All of its (DEPTH+1)-byte sequences make the tree, however many there are, so the tree is
held nowhere whole. Contexts longer than ``TOP`` bytes are dealt to slots by their last ``TOP`` + 1
bytes, which keeps every such node with all its children in one slot; what these subtrees add up to
makes the top, whose size has a bound that no input moves.

Texts are read in blocks. A block asks each slot once for the sequences and words it has, as sorted
differences in compressed bytes, and brings its own counts along; the slot adds the counts up, scores
what is asked, and answers in the same order. Words are counted in the same slots.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm._shared import LOWER, held_out, materialize, texts

MODULUS = 5
DEPTH = 5
#: Contexts up to this length are one small tree (256**3 contexts and bytes at most); longer ones are dealt out.
TOP = 2
#: Bytes of text that ask together, that are looked at together, and that there is a slot for.
_BLOCK, _CHUNK, _SLOT = 24 << 20, 2 << 20, 16 << 20
#: Sequences that wait for their merge.
_PENDING = 2 << 20
_END = b"\n"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SMALL = np.array([math.lgamma(k + 0.5) for k in range(256)])


def words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(LOWER).split()


def _word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in runs of about _CHUNK bytes, so that those of a long text are never all held."""
    raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while len(raw) - at > _CHUNK and (cut := _SPACE.search(raw, at + _CHUNK)):
        yield words(raw[at : cut.start()])
        at = cut.end()
    yield words(raw[at:] if at else raw)


def grams(texts: list[bytes], contexts: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH+1)-byte sequence that ends at each byte of each text (one long each), and every text's number of bytes.

    ``contexts`` are the DEPTH bytes before each text; a text that begins has end bytes before it.
    """
    flat = np.frombuffer(b"".join([c + t for c, t in zip(contexts or [_END * DEPTH] * len(texts), texts, strict=True)]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    g = np.zeros(len(flat) - DEPTH if len(flat) else 0, np.int64)
    for j in range(DEPTH + 1):
        g = g << 8 | flat[j : len(flat) - DEPTH + j]
    if len(texts) > 1:  # leave out what ends inside the context of the next text
        starts = np.cumsum(sizes + DEPTH)[:-1]
        keep = np.ones(len(g), bool)
        keep[(starts[:, None] - DEPTH + np.arange(DEPTH)[None, :]).ravel()] = False
        g = g[keep]
    return g, sizes


def _gram_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences, sizes and positions of texts in runs of about _CHUNK bytes; a longer text comes in parts."""
    parts, contexts, owners, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), _CHUNK):
            part = t[at : at + _CHUNK]
            if size + len(part) > _CHUNK and parts:
                yield *grams(parts, contexts), np.array(owners)
                parts, contexts, owners, size = [], [], [], 0
            parts.append(part)
            contexts.append((_END * DEPTH + t[max(0, at - DEPTH) : at])[-DEPTH:])
            owners.append(i)
            size += len(part)
    if parts:
        yield *grams(parts, contexts), np.array(owners)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about _CHUNK bytes of text, so that its words are never all held at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(ends // _CHUNK)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    key, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, counts))
    # runs in order are merged; np.unique with its inverse holds half as much again
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first: small ones take little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _spread(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _squeeze_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _spread_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _gram_slots(gram: np.ndarray, slots: int) -> np.ndarray:
    suffix = (gram >> 8 & (1 << 8 * (TOP + 1)) - 1).astype(np.uint64)
    return (suffix * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % slots


_TALLY = "slot int, block long, doc_ids array<long>, held array<boolean>, learning long, text binary, grams binary, gram_n binary, words binary, word_n binary"
_FIELDS = {"slot": pa.int32(), "block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "learning": pa.int64(), "text": pa.binary(), "grams": pa.binary(), "gram_n": pa.binary(), "words": pa.binary(), "word_n": pa.binary()}


def _rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _FIELDS.items()], names=[*_FIELDS])


class _Block:
    """What a block of texts asks for: its sequences and words with their counts in learning texts."""

    def __init__(self) -> None:
        self.size, self.grams, self.gram_n, self.words, self.word_n = 0, [], [], [], []

    def add(self, clean: list[bytes], held: list[bool]) -> None:
        for kind in (False, True):  # held-out texts ask, but do not count
            mine = [t + _END for t, h in zip(clean, held, strict=True) if h == kind]
            for g, _, _ in _gram_runs(mine):
                seen, n = np.unique(g, return_counts=True)
                self.grams.append(seen)
                self.gram_n.append(np.zeros(len(n), np.int64) if kind else n)
            for t in mine:
                self.size += len(t)
            found = pc.value_counts(pa.array([w for t in mine for w in t.split()], pa.binary()))
            self.words.append(found.field("values"))
            self.word_n.append(np.zeros(len(found), np.int64) if kind else found.field("counts").to_numpy())
        if len(self.grams) > 16 or sum(map(len, self.grams[1:])) > _PENDING:
            self.grams, self.gram_n = ([x] for x in _merge(self.grams, self.gram_n))

    def asked(self, block: int, slots: int) -> Iterator[pa.RecordBatch]:
        gram, n = _merge(self.grams, self.gram_n)
        order = np.argsort(of := _gram_slots(gram, slots), kind="stable")
        gram, n, gram_cuts = gram[order], n[order], np.searchsorted(of[order], np.arange(slots + 1))
        every = pa.concat_arrays(self.words) if self.words else pa.array([], pa.binary())
        found = pc.dictionary_encode(every)
        word = found.dictionary.to_pylist()
        word_n = np.bincount(found.indices.to_numpy(), np.concatenate(self.word_n), len(word)).astype(np.int64) if word else np.empty(0, np.int64)
        of = np.fromiter(map(xxhash.xxh64_intdigest, word), np.uint64, len(word)) % np.uint64(slots)
        order = np.argsort(of, kind="stable")
        word, word_n, word_cuts = [word[i] for i in order.tolist()], word_n[order], np.searchsorted(of[order], np.arange(slots + 1, dtype=np.uint64))
        for slot in range(slots):
            (a, b), (c, d) = gram_cuts[slot : slot + 2], word_cuts[slot : slot + 2]
            if a < b or c < d:
                yield _rows(
                    slot=[slot], block=[block], grams=[_squeeze(np.diff(gram[a:b], prepend=0))], gram_n=[_squeeze(n[a:b])],
                    words=[_squeeze_bytes(b"".join(w + _END for w in word[c:d]))], word_n=[_squeeze(word_n[c:d])],
                )


def _tally(slots: int, most: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cleaned texts, and what each block of them asks of each slot."""
        from pyspark import TaskContext

        block, asks = TaskContext.get().partitionId() << 32, _Block()
        for b in (c for batch in batches for c in _chunks(batch)):
            held = b.column("held_out").to_pylist()
            clean = [b" ".join(filter(None, (b" ".join(run) for run in _word_runs(t)))) for t in texts(b)]
            packed = _squeeze_bytes(b"".join(t + _END for t in clean))
            yield _rows(block=[block], doc_ids=[b.column("doc_id").to_pylist()], held=[held], learning=[held.count(False)], text=[packed])
            asks.add(clean, held)
            if asks.size >= most:
                yield from asks.asked(block, slots)
                block, asks = block + 1, _Block()
        yield from asks.asked(block, slots)

    return tally


def _lgamma_half(k: np.ndarray) -> np.ndarray:
    """log Gamma(k + 1/2) for whole numbers."""
    x = k + 0.5
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k < 256, _SMALL[np.minimum(k, 255)], large)


def _lgamma_one(k: np.ndarray) -> np.ndarray:
    """log Gamma(k + 1) for whole numbers."""
    x = k + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    small = np.array([math.lgamma(i + 1.0) for i in range(256)])
    return np.where(k < 256, small[np.minimum(k, 255)], large)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of ``a`` zeros and ``b`` ones."""
    return _lgamma_half(a) + _lgamma_half(b) - _lgamma_one(a + b) - math.log(math.pi)


class Tree:
    """Nodes of all depths for each of the eight decisions, from counts of sequences.

    ``levels[i]`` holds sorted (d+1)-byte sequences and their counts, d being ``low`` + i. A node's key
    is its context and the bits so far; for each it keeps the weight of its own estimate, the estimate,
    and that of the children which are not kept. ``below[j]`` is what the children of the last level
    add up to, when they are elsewhere: keys of that level, zeros, ones, log weighted probability.
    ``sums[j]`` is the same for whoever holds the level before the first.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], low: int = 0, below: list[tuple[np.ndarray, ...]] | None = None) -> None:
        self.low, self.nodes, self.sums = low, [], []
        for j in range(8):
            nodes, (key, n0, n1, weighted) = self._decision(levels, j, low, below and below[j])
            self.nodes.append(nodes)
            if low:
                parent, back = np.unique(key & ((1 << (8 * (low - 1) + j)) - 1), return_inverse=True)
                self.sums.append((parent, *(np.bincount(back, x, len(parent)).astype(x.dtype) for x in (n0, n1, weighted))))

    @staticmethod
    def _decision(levels: list[tuple[np.ndarray, np.ndarray]], j: int, low: int, below: tuple[np.ndarray, ...] | None) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
        out: list[tuple[np.ndarray, ...]] = []
        for d in range(low + len(levels) - 1, low - 1, -1):
            gram, count = levels[d - low]
            key = gram >> (8 - j)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            one = gram >> (7 - j) & 1
            n = np.add.reduceat(count, first) if len(key) else count
            n1 = np.add.reduceat(count * one, first) if len(key) else count
            key, n0 = key[first], n - n1
            own = log_kt(n0, n1)
            r0, r1, children = n0.copy(), n1.copy(), np.zeros(len(key))
            if below is not None and len(below[0]):
                parent = np.searchsorted(key, below[0] & ((1 << (8 * d + j)) - 1))
                r0 -= np.bincount(parent, below[1], len(key)).astype(np.int64)
                r1 -= np.bincount(parent, below[2], len(key)).astype(np.int64)
                children = np.bincount(parent, below[3], len(key))
            if below is None:
                weighted, share = own, np.ones(len(key))
            else:
                children = children + log_kt(r0, r1)
                weighted = np.logaddexp(own, children) - math.log(2)
                share = np.exp(own - math.log(2) - weighted)
            below = key, n0, n1, weighted
            out.append((key, share, (n1 + 0.5) / (n + 1), (r1 + 0.5) / (r0 + r1 + 1)))
        return out[::-1], below

    def chances(self, g: np.ndarray, below: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each decision, the probability of the bit that each sequence's last byte has and whether the context has a node.

        ``below`` is the same from the depths after this tree's.
        """
        out = []
        for j, depths in enumerate(self.nodes):
            one = (g >> (7 - j) & 1).astype(bool)
            p, there = below[j] if below else (np.zeros(len(g)), np.zeros(len(g), bool))
            for d in range(self.low + len(depths) - 1, self.low - 1, -1):
                key, share, own, other = depths[d - self.low]
                if not len(key):
                    continue
                want = g >> (8 - j) & ((1 << (8 * d + j)) - 1)
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[at] == want
                bit = lambda x: np.where(one, x, 1 - x)  # noqa: B023, E731
                mixed = share[at] * bit(own[at]) + (1 - share[at]) * np.where(there, p, bit(other[at]))
                p, there = np.where(hit, mixed, 0), hit
            out.append((p, there))
        return out

    def log10(self, g: np.ndarray, below: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 probability of each sequence's last byte after the others."""
        total = np.zeros(len(g))
        for p, there in self.chances(g, below):
            total += np.log10(np.where(there, p, 0.5))
        return total


def _levels(gram: np.ndarray, n: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels ``low`` to ``high`` from counted sequences that are long enough."""
    out = []
    for d in range(low, high + 1):
        short, back = np.unique(gram & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        out.append((short, np.bincount(back, n, len(short)).astype(np.int64)))
    return out


def _counted(asked: pa.Table) -> tuple[Tree, dict[bytes, int]]:
    """The tree of the depths after TOP of a slot, and the counts of its words."""
    grams, counts, vocabulary = [], [], {}
    for part in asked.to_batches():
        for g, n, w, c in zip(*(part.column(x).to_pylist() for x in ("grams", "gram_n", "words", "word_n")), strict=True):
            gram, number = np.cumsum(_spread(g, np.int64)), _spread(n, np.int64)
            grams.append(gram[number > 0])
            counts.append(number[number > 0])
            if len(grams) > 64:
                grams, counts = ([x] for x in _merge(grams, counts))
            for word, times in zip(_spread_bytes(w).split(), _spread(c, np.int64).tolist(), strict=True):
                if times:
                    vocabulary[word] = vocabulary.get(word, 0) + times
    return Tree(_levels(*_merge(grams, counts), TOP + 1, DEPTH), TOP + 1), vocabulary


_WORDS = -1
_SUMS = "j int, key long, n0 long, n1 long, weighted double"


def _sums(asked: pa.Table) -> pa.Table:
    """What a slot's subtrees add up to, and its number of words and different words."""
    tree, vocabulary = _counted(asked)
    rows = [[np.full(len(columns[0]), j, np.int32), *columns] for j, columns in enumerate(tree.sums)]
    rows.append([np.array([_WORDS], np.int32), np.zeros(1, np.int64), np.array([sum(vocabulary.values())]), np.array([len(vocabulary)]), np.zeros(1)])
    kinds = (np.int32, np.int64, np.int64, np.int64, np.float64)
    return pa.table({c: np.concatenate(x).astype(k) for c, x, k in zip(("j", "key", "n0", "n1", "weighted"), zip(*rows, strict=True), kinds, strict=True)})


def _top(asked: DataFrame) -> tuple[Tree, int, int]:
    """The tree of contexts of up to TOP bytes, whose size depends on the number of different bytes alone; all words and different words."""
    sums = asked.groupBy("slot").applyInArrow(_sums, _SUMS)
    # decimals, so that the sum does not depend on the order of the tasks
    table = sums.groupBy("j", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("weighted").cast("decimal(28,9)")).cast("double").alias("weighted")).toArrow()
    j, key, n0, n1, weighted = (table.column(c).to_numpy() for c in ("j", "key", "n0", "n1", "weighted"))
    below = []
    for k in range(8):
        at = np.flatnonzero(j == k)
        at = at[np.argsort(key[at])]
        below.append((key[at], n0[at], n1[at], weighted[at]))
    total, distinct = int(n0[j == _WORDS].sum()), int(n1[j == _WORDS].sum())
    key, n0, n1, _ = below[7]
    gram, n = np.concatenate((key << 1, key << 1 | 1)), np.concatenate((n0, n1))
    return Tree(_levels(gram[n > 0], n[n > 0], 0, TOP), 0, below), total, distinct


_ANSWER = "block long, grams binary, log binary, words binary, word_c binary"


def _answers(shared):
    def answer(asked: pa.Table) -> pa.Table:
        """What a slot tells each block: log10 probabilities (rounded to 4 bytes) and counts, in the order asked."""
        tree, vocabulary = _counted(asked)
        out = []
        for part in asked.to_batches():
            for block, g, w in zip(*(part.column(x).to_pylist() for x in ("block", "grams", "words")), strict=True):
                gram = np.cumsum(_spread(g, np.int64))
                log = shared.value.log10(gram, tree.chances(gram)).astype(np.float32)
                count = np.array([vocabulary.get(x, 0) for x in _spread_bytes(w).split()], np.int64)
                out.append((block, g, _squeeze(log), w, _squeeze(count)))
        columns = zip(*out, strict=True)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("block", "grams", "log", "words", "word_c"), columns, (pa.int64(), *[pa.binary()] * 4), strict=True)})

    return answer


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def _score_texts(n: int, v: int, docs: int):
    """Scores a block's texts from its answers."""
    scale = math.log10(n + 0.5 * (v + 1))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        told = {c: [x for x in answers.column(c).to_pylist()] for c in ("grams", "log", "words", "word_c")}
        gram = np.concatenate([np.empty(0, np.int64), *(np.cumsum(_spread(x, np.int64)) for x in told["grams"])])
        log = np.concatenate([np.empty(0, np.float32), *(_spread(x, np.float32) for x in told["log"])]).astype(float)
        known, word = pa.array(gram), pa.array([w for x in told["words"] for w in _spread_bytes(x).split()], pa.binary())
        count = np.concatenate([np.empty(0, np.int64), *(_spread(x, np.int64) for x in told["word_c"])])
        out = []
        for ids, held, packed in zip(*(rows.column(c).to_pylist() for c in ("doc_ids", "held", "text")), strict=True):
            clean = _spread_bytes(packed).split(_END)[:-1]
            found = np.zeros(len(clean))
            for g, sizes, owner in _gram_runs([t + _END for t in clean]):
                at = pc.index_in(pa.array(g), value_set=known).to_numpy()
                starts = np.append(0, np.cumsum(sizes)[:-1])
                found += np.bincount(owner, np.add.reduceat(log[at], starts), len(clean))
            split = [t.split() for t in clean]
            lens = np.array([len(w) + 1 for w in split])
            c = count[pc.index_in(pa.array([w for ws in split for w in ws], pa.binary()), value_set=word).to_numpy()] if len(word) else np.empty(0, np.int64)
            c = np.insert(c, np.cumsum(lens - 1), docs)
            starts = np.append(0, np.cumsum(lens)[:-1])
            columns = {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(lens.astype(np.int64))}
            columns |= {"n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), "base_score": pa.array(np.add.reduceat(np.log10(c + 0.5) - scale, starts))}
            columns |= {"score": pa.array(found), "bits_per_byte": pa.array(-found * math.log2(10) / np.array([len(t) + 1 for t in clean]))}
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return score


def scores(docs: DataFrame, block_bytes: int = _BLOCK, slot_bytes: int = _SLOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``.

    Learns from rows whose crc32(doc_id) mod 5 is not 1 (rows without an id among them). ``score`` is
    log10 of the model's probability of the lower-cased words, joined by one space, and the end;
    ``bits_per_byte`` is the same as a code length for each of these bytes. Null, empty and blank texts
    are the end alone; texts are scored whole; repeated rows each count in training and each get a row;
    other columns are ignored; an empty table gives no rows; without any learning row every bit has
    probability 1/2 and every base probability is 1. ``block_bytes`` and ``slot_bytes`` size the work of
    a task and change no result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id"), MODULUS))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // slot_bytes + 1)
    tally = materialize(narrow.mapInArrow(_tally(slots, block_bytes), _TALLY), "ctw-tally")
    asked = tally.where(F.col("slot").isNotNull()).select("slot", "block", "grams", "gram_n", "words", "word_n")
    rows = tally.where(F.col("slot").isNull()).select("block", "doc_ids", "held", "text")
    trained = tally.agg(F.sum("learning")).first()[0] or 0
    top, total, distinct = _top(asked)
    n, v = total + trained, distinct + (trained > 0)
    answers = asked.groupBy("slot").applyInArrow(_answers(spark.sparkContext.broadcast(top)), _ANSWER)
    done = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_texts(n, v, trained), _SCORED)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    return done.withColumn("train_tokens", F.lit(n).cast("long")).select(*columns)
