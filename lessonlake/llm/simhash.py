"""SimHash near-duplicates, found through signatures of three blocks in six.

A 64-bit fingerprint is cut into six blocks. Of two fingerprints that differ in three bits at most,
three blocks at least are equal, so the two share at least one of the 20 signatures "these three
blocks", each of 31 to 33 bits. An equality join on signatures therefore finds every link, and each is
verified on the whole fingerprint. Copies of one fingerprint are one node throughout.

Inside a signature no product of its members is made. The bits that a signature leaves out are cut
into four pieces, of which a link has at least one in common. Members are dealt to parts by the last
piece; in a part they are linked to their neighbour in sorted order and to the smallest, and the
smallest members of a signature's parts are linked alike. Only signatures that still hold more than
one component after that are looked at again: whoever is outside the largest component meets the
members with which it shares one of the four pieces, as any link must.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.llm._shared import LOWER, materialize, packed
from lessonlake.llm.components import components

SHINGLE = 3
DISTANCE = 3
_CHUNK = 1 << 16
#: First bit and width of each block, and the blocks that each signature keeps.
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
_KEPT = list(combinations(range(len(_BLOCKS)), len(_BLOCKS) - DISTANCE))
#: Bits of a signature below its number.
_KEY_BITS = 33


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Majority of the XXH64 (seed 42) of all n-word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    digest, total, votes = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(found, pa.int64())], names=["doc_id", "tag", "fp"])


def _tag() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``tag`` (a hash of the text) and ``fp``, the fingerprint as a signed long, of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _tag().alias("tag"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, tag long, fp long")


def _near(a: str, b: str, distance: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _neighbours(members: DataFrame, *group: str) -> DataFrame:
    """(a, b): each member of a group with the one before it, and with the smallest."""
    order = Window.partitionBy(*group).orderBy("fp")
    beside = members.withColumns({"back": F.lag("fp").over(order), "least": F.first("fp").over(order)})
    beside = beside.select("fp", F.explode(F.array("back", "least")).alias("b"))
    return beside.select(F.col("fp").alias("a"), "b").where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def _signature(number: int) -> F.Column:
    """The bits of the kept blocks side by side, below the signature's number."""
    sig, at = F.lit(number << _KEY_BITS).cast("long"), 0
    for first, width in (_BLOCKS[b] for b in _KEPT[number]):
        block = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        sig, at = sig.bitwiseOR(F.shiftleft(block, at)), at + width
    return sig


def _pieces(number: int) -> list[int]:
    """Masks, as signed longs, of the pieces of what a signature leaves out."""
    left_out = [first + i for b, (first, width) in enumerate(_BLOCKS) if b not in _KEPT[number] for i in range(width)]
    masks = [sum(1 << int(bit) for bit in piece) for piece in np.array_split(left_out, DISTANCE + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _piece(i: int) -> F.Column:
    """Piece ``i`` (0 to 3) of the bits that the signature leaves out, in their places."""
    masks = F.array(*[F.lit(_pieces(number)[i]).cast("long") for number in range(len(_KEPT))])
    return F.col("fp").bitwiseAND(F.get(masks, F.shiftrightunsigned("sig", _KEY_BITS).cast("int")))


def fingerprint_roots(nodes: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of ``nodes`` (distinct longs ``fp``) that has a link."""
    # spread first: a file of fingerprints is small, and each becomes 20 rows
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    signed = spread.select("fp", F.explode(F.array(*[_signature(number) for number in range(len(_KEPT))])).alias("sig"))
    # counted before the join, which can then split a hot signature
    often = materialize(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"), "repeated-signatures")
    shared = signed.join(often, "sig").select("sig", "fp")
    shared = materialize(shared.withColumn("part", _piece(DISTANCE)), "signatures")

    heads = shared.groupBy("sig", "part").agg(F.min("fp").alias("fp"))
    links = _neighbours(shared, "sig", "part").unionByName(_neighbours(heads, "sig"))
    links = materialize(links.where(_near("a", "b", DISTANCE)).distinct(), "links")
    roots = materialize(components(links), "roots")

    labelled = shared.select("sig", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = materialize(labelled.select("sig", "fp", F.coalesce("root", "fp").alias("root")), "labelled-signatures")
    sizes = labelled.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    open_sigs = sizes.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    open_sigs = materialize(open_sigs.select("sig", F.col("most.root").alias("largest")), "open-signatures")
    pieces_of = F.posexplode(F.array(*[_piece(i) for i in range(DISTANCE + 1)])).alias("at", "piece")
    open_rows = materialize(labelled.join(open_sigs, "sig").select("sig", "fp", "root", "largest", pieces_of), "open-members")
    left = open_rows.where("root <> largest").select("sig", "at", "piece", F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = open_rows.select("sig", "at", "piece", F.col("fp").alias("b"), F.col("root").alias("rb"))
    across = left.join(right, ["sig", "at", "piece"]).where((F.col("ra") != F.col("rb")) & _near("a", "b", DISTANCE))
    across = materialize(across.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if across.isEmpty():
        return roots.withColumnRenamed("node", "fp")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(across)).withColumnRenamed("node", "fp")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tag, fp and component_id of every row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-nodes")
    roots = fingerprint_roots(nodes.select("fp"))
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most three differing bits, the
    row's own included. Null, empty and blank texts have fingerprint zero and link like any other;
    equal texts share a fingerprint; repeated rows each get a row; null ids are passed over in the
    minimum (a component of null ids alone has a null id); other columns are ignored; an empty table
    gives no rows.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_ROW_KEY = ["k_tag", "k_id", "k_none"]


def _row_key(doc_id: F.Column, tag: F.Column) -> list[F.Column]:
    """Columns without nulls, so that joins and groups partition by them alike."""
    return [tag.alias("k_tag"), F.coalesce(doc_id, F.lit(0)).alias("k_id"), doc_id.isNull().alias("k_none")]


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component, with all columns: that of the smallest doc_id.

    Of rows that share the smallest id, one of the text with the smallest hash stays; a component of
    null ids alone keeps one row. Null, empty and blank texts are one component; an empty table gives
    no rows; all columns stay, whatever their names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")
    winners = _grouped(docs).groupBy("root").agg(first).select(*_row_key(F.col("first.doc_id"), F.col("first.tag")))
    rows = docs.select(packed(docs), *_row_key(F.col("doc_id").cast("long"), _tag()))
    # repeated rows first, on the keys of the join: they are combined before a shuffle that the join then shares
    return rows.dropDuplicates(_ROW_KEY).join(winners, _ROW_KEY, "left_semi").select("packed.*")
