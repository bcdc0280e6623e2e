"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of all words that are new to a task lie in one flat array. In each round, the ranks of
all neighbouring pairs are found by one binary search over the sorted pair keys, each word's lowest
rank is taken, and all its occurrences in that word are merged at once, from the left. As every
merge makes a token of its own, a pair with a new token always ranks after the merge that made it,
so a round merges what one-at-a-time merging would.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space of the Unicode standard, as the normalizer's \s (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHIFT = 32
_NO_RANK = np.int64(1 << 40)
#: A task forgets its encoded words beyond this many, which bounds memory and changes no result.
CACHED_WORDS = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for the JSON text of a ``tokenizers`` file with word-end suffix, lower-casing and byte-level symbols."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        left, right, made = np.array(pairs, np.int64).T
        keys = left << _SHIFT | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.names = [str(i) for i in range(len(self.tokens))]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.controls = regex.compile(r"[\x1c-\x1f]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        """Compose, lower-case each character by itself (no final sigma) and split at white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        # str.split() differs from the normalizer's white space in four control characters alone
        return self.spaces.split(text) if self.controls.search(text) else text.split()

    def words(self, text: str) -> list[str]:
        """The text's space-separated words in order; the strings of special tokens stand for themselves."""
        if "<|" not in text:
            return self.split(text)
        found: list[str] = []
        for part in self.marks.split(text):
            found += [part] if part in self.special else self.split(part)
        return found

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (UTF-8, not empty) in one array, and the end of each word's ids there."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] << _SHIFT | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(fits, self.ranks[at], _NO_RANK), _NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            live = lowest < _NO_RANK
            p = np.flatnonzero(live & (rank == lowest))
            # of overlapping occurrences (a a a), every other one from the left
            start = np.append(True, np.diff(p) != 1) if len(p) else np.empty(0, bool)
            p = p[(np.arange(len(p)) - np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))) % 2 == 0]
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym[p] = self.made[at[p]]
            live[p + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")]
        return sym, np.cumsum(np.bincount(word, minlength=len(words)))

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet, all in one batch. No piece reaches over a space."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        self.known |= {w: [self.special[w]] for w in new if w in self.special}
        plain = [w for w in new if w not in self.special]
        found = [self.pieces.findall(w) for w in plain]
        pieces = [p.encode("utf-8", "surrogatepass") for f in found for p in f]
        flat, ends = self.merge(pieces) if pieces else (np.empty(0, np.int64), np.empty(0, np.int64))
        at = np.append(0, ends)[np.cumsum([0, *map(len, found)])].tolist()
        ids = flat.tolist()
        self.known |= {w: ids[a:b] for w, a, b in zip(plain, at[:-1], at[1:], strict=True)}

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text, in order; the new words of all texts are merged together."""
        words = [self.words(t) for t in texts]
        self.learn(chain.from_iterable(words))
        known = self.known
        for found in words:
            yield [*chain.from_iterable(map(known.__getitem__, found))]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids``, space-joined: this vocabulary's file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _encoder(shared) -> object:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = list(bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(bpe.names.__getitem__, i)).encode()).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encode


def _tokens(shared) -> object:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = list(bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode


def _shared(docs: DataFrame, path: str | None) -> tuple[DataFrame, object]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text"), spec


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; see ``encode_digests`` for odd cases."""
    narrow, bpe = _shared(docs, path)
    return narrow.mapInArrow(_tokens(bpe), "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and of the decoded text, for every row of ``docs``.

    ``path`` is the vocabulary file, read by the driver and sent to the executors (its size is fixed,
    about 49,000 merges). Null and empty texts have no tokens and decode to the empty text; repeated
    rows each get a row; null ids stay null; a word of any length is encoded whole; other columns are
    ignored; an empty table gives no rows.
    """
    narrow, bpe = _shared(docs, path)
    return narrow.mapInArrow(_encoder(bpe), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
