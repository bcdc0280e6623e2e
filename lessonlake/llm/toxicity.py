"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled sample takes the documents of ``labels``
whatever their label says, toxic ones among them. The class prior is the share of toxic rows among the
labelled ones. How often a word occurs is counted over all learning documents. A linear classifier on hashed
word and word-beginning features is trained with numpy on the prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

(Kiryo et al. 2017): where the bracket turns negative the step ascends it instead, which keeps the
classifier from learning the few positives by heart. A feature's value is how much oftener it occurs
in a text than in the corpus, so it depends little on the text's length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm._shared import held_out, materialize, texts

MODULUS = 3
THRESHOLD = 0.7
#: Bounds of the sample of labelled rows that fits the classifier, taken in the order of a hash of doc_id.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
BUCKETS = 1 << 18
#: Standard errors that a bucket's rates lie apart; by chance, one bucket in 700.
SIGNIFICANT = 3.0
BEGINNINGS = range(4, 9)
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CACHED = 1 << 18


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: itself, and its beginnings of 4 to 8 characters."""
    bare = word.strip(_EDGES)
    parts = {f"={bare}", *(bare[:n] for n in BEGINNINGS if len(bare) >= n)} if bare else ()
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 7) % BUCKETS for p in parts]


class Counts:
    """Bucket counts of texts; ``chosen`` maps a bucket to its position and leaves out all others."""

    def __init__(self, chosen: dict[int, int] | None = None) -> None:
        self.chosen, self.known = chosen, {}

    def _of(self, word: str) -> list[int]:
        found = features(word)
        if self.chosen is not None:
            found = [self.chosen[f] for f in found if f in self.chosen]
        if len(self.known) > _CACHED:
            self.known.clear()
        self.known[word] = found or ()
        return found

    def __call__(self, text: str | None) -> tuple[int, Counter]:
        """Number of words and the count of each bucket."""
        words, total = (text or "").lower().split(), Counter()
        known = self.known
        for w in words:
            f = known[w] if w in known else self._of(w)
            if f:
                total.update(f)
        return len(words), total


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and unlabelled texts have each bucket."""
    count, sums = Counts(), np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for text, positive in zip(texts(b), b.column("positive").to_pylist(), strict=True):
            at = np.fromiter(count(text)[1], np.int64)
            sums[0 if positive else 1, at] += 1
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, sums[:, at])], names=["bucket", "p", "u"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts with their counts, in parts that a task can hold."""
    total: Counter = Counter()

    def told() -> pa.RecordBatch:
        names = [w.encode("utf-8", "surrogatepass") for w in total]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([*total.values()], pa.int64())], names=["word", "n"])

    for b in batches:
        for text in texts(b):
            total.update((text or "").lower().split())
            if len(total) > _CACHED:
                yield told()
                total.clear()
    yield told()


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each bucket, and of all words (-1)."""
    sums = np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            sums[-1] += n
            for f in features(word.decode("utf-8", "surrogatepass")):
                sums[f] += n
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at)), pa.array(sums[at])], names=["bucket", "n"])


def _values(count: Counts, background: np.ndarray, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    n, total = count(text)
    at = np.fromiter(total, np.int64, len(total))
    return at, np.log2(1 + np.fromiter(total.values(), float, len(total)) / (1 + n * background[at]))


def _sparse(chosen: dict[int, int], background: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(chosen)
        for b in batches:
            found = [_values(count, background, t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["positive", "at", "v"])

    return rows


class _Rows:
    """A sparse matrix: rows of features that are mostly absent. Entries are put in one order, so that sums don't depend on the tasks."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, here: np.ndarray, width: int) -> None:
        self.size, self.width = int(here.sum()), width
        row = (np.cumsum(here) - 1)[row]
        # rows by their content: the sum and the first of their values
        total, first = np.bincount(row, value, self.size), np.full(self.size, width)
        np.minimum.at(first, row, column)
        place = np.empty(self.size, np.int64)
        place[np.lexsort((np.bincount(row, value * column, self.size), total, first))] = np.arange(self.size)
        order = np.lexsort((column, place[row]))
        self.row, self.column, self.value = place[row][order], column[order], value[order]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.size)

    def mean(self, slope: np.ndarray) -> np.ndarray:
        """The mean over rows of slope times features, and of the slope."""
        return np.append(np.bincount(self.column, self.value * slope[self.row], self.width), slope.sum()) / self.size


def risk(positive: _Rows, unlabelled: _Rows, prior: float, theta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of weights and bias: the positive part and the bracket of the risk under the logistic loss, and their gradients."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    gp, gu = (sigmoid(x.times(theta[:-1]) + theta[-1]) for x in (positive, unlabelled))
    loss = lambda g: -np.log(np.clip(g, 1e-12, 1)).mean()
    bracket = loss(1 - gu) - prior * loss(1 - gp)
    return prior * loss(gp), bracket, prior * positive.mean(gp - 1), unlabelled.mean(gu) - prior * positive.mean(gp)


def nnpu(positive: _Rows, unlabelled: _Rows, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the least non-negative risk, by Adam on all rows."""
    theta, m, v = (np.zeros(positive.width + 1) for _ in range(3))
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, bracket, plus, minus = risk(positive, unlabelled, prior, theta)
        g = plus + minus if bracket >= 0 else -minus
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


class Model:
    """What scoring needs: chosen buckets, their background rates, weights and bias. Its size is fixed."""

    def __init__(self, chosen: dict[int, int], background: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.background, self.weights, self.bias = chosen, background, weights, bias


def _background(docs: DataFrame) -> np.ndarray:
    """The share of each bucket in the words of all learning documents."""
    learning = docs.where(~held_out(F.col("doc_id").cast("long"), MODULUS)).select("text")
    words = learning.mapInArrow(_vocabulary, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = words.mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    sums = np.zeros(BUCKETS + 1, np.int64)
    sums[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return sums[:BUCKETS] / max(1, int(sums[-1]))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on rows whose crc32(doc_id) mod 3 is not 1: at most ``max_positive`` toxic and ``max_unlabelled`` labelled texts, whose labels are not looked at.

    Background rates are those of all learning documents; every bucket that is significantly commoner
    in toxic texts is a feature. Without a toxic or without an unlabelled learning row, the model
    scores everything 0.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"))
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), MODULUS))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = told.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    toxic = told.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("positive"))
    other = told.orderBy(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("positive"))
    # two bounded lists of ids, so they may be broadcast; a toxic row may be among the unlabelled too
    chosen_ids = F.broadcast(toxic.unionByName(other))
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen_ids, "doc_id"), "tox-sample")
    size = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    empty = Model({}, np.zeros(0), np.zeros(0), -50.0)
    if not prior or size.get(1, 0) == 0 or size.get(0, 0) == 0:
        return empty
    prior = min(max(prior, 1e-4), 0.9)

    sums = sample.select("text", "positive").mapInArrow(_tally, "bucket long, p long, u long")
    rows = sums.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()  # BUCKETS rows at most
    bucket, p, u = (rows.column(c).to_numpy() for c in ("bucket", "p", "u"))
    fp, fu = p / size[1], u / size[0]
    pooled = (p + u) / (size[1] + size[0])
    z = (fp - fu) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / size[1] + 1 / size[0]))
    use = np.sort(bucket[(p >= 2) & (z > SIGNIFICANT)])
    if not len(use):
        return empty
    chosen, background = {int(b): i for i, b in enumerate(use)}, _background(docs)[use]

    found = sample.select("text", "positive").mapInArrow(_sparse(chosen, background), "positive int, at array<long>, v array<double>").toArrow()
    at, v = found.column("at").combine_chunks(), found.column("v").combine_chunks()
    rows_of, flat, values = np.repeat(np.arange(found.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(), v.flatten().to_numpy()
    is_p = found.column("positive").to_numpy() == 1
    sides = [_Rows(rows_of[is_p[rows_of] == side], flat[is_p[rows_of] == side], values[is_p[rows_of] == side], is_p == side, len(use)) for side in (True, False)]
    weights, bias = nnpu(*sides, prior)
    return Model(chosen, background, weights, bias)


def _scorer(chosen: dict[int, int], background: np.ndarray, weights: np.ndarray, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(chosen)
        for b in batches:
            out = []
            for text in texts(b):
                at, v = _values(count, background, text)
                out.append(float(1 / (1 + np.exp(-np.clip(v @ weights[at] + bias, -50, 50)))))
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the score of a text without features."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_scorer(model.chosen, model.background, model.weights, model.bias), "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    ``labels`` (doc_id, toxic) is used for learning rows alone; repeated labels of a document count
    once, as toxic if one is; null labels and ids teach nothing. Whole texts are scored; repeated
    rows each get a row and equal texts equal scores; rows without an id are scored like any other and
    are not held out; other columns are ignored; an empty table gives no rows.
    """
    scored = score(docs, train(docs, labels, max_positive, max_unlabelled))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _marker(column: str, chosen: dict[int, int], background: np.ndarray, weights: np.ndarray, bias: float):
    inner = _scorer(chosen, background, weights, bias)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (scored,) = inner(iter([pa.RecordBatch.from_arrays([b.column(column)], names=["text"])]))
            yield b.filter(pa.array(np.asarray(scored.column("score")) < THRESHOLD))

    return keep


def keep_clean(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic.

    Null and empty texts are scored like any other, as texts without features; repeated rows share
    their fate; columns may have any names; an empty table gives no rows. See ``predictions``.
    """
    model = train(docs, labels, max_positive, max_unlabelled)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that a Python function can be given
    marker = _marker(f"c{docs.columns.index('text')}", model.chosen, model.background, model.weights, model.bias)
    return plain.mapInArrow(marker, plain.schema).toDF(*docs.columns)
