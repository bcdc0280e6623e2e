"""Near-duplicate pairs by exact prefix filtering, and greedy acceptance over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators.retrieval import body
from lessonlake.sources.shared import drop_table, materialize

SAVE_THRESHOLD, SUGGEST_THRESHOLD = 0.85, 0.6
#: So many of their rarest common tokens must two sets meet at; buckets that tokens are counted in.
MET, _BUCKETS = 8, 1 << 22


def token_classes(rows: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with equal token sets inside one task type and kind are a class, named by its earliest member.

    Returns members (id, rep), classes (row, rep, created_at) and sets (row, grp, words), all written
    tables. Tokens are written once, joined by spaces, and stay where they are: a class knows those of
    its earliest member by the number of their row. The earliest member is pre-aggregated before its shuffle and written
    before the join, which can so split a class that holds a large share of all rows. Only ids in
    ``among`` are members, where it is given; their texts need not be joined with it.
    """
    sets = rows.select("id", "created_at", F.concat_ws("|", "task_type", "kind").alias("grp"), F.array_join(F.array_sort(T.tokens(body())), " ").alias("words"))
    sets = sets.withColumns({"key": F.sha2(F.concat_ws(" ", "grp", "words"), 256), "row": F.monotonically_increasing_id()})
    # not before it is written: the filter would make the tokens once more
    sets = materialize(sets, "token-sets").where("words <> ''")
    slim = sets.select("id", "created_at", "key", "row")
    if among is not None:
        slim = slim.join(among.select("id"), "id", "left_semi")
    firsts = materialize(slim.groupBy("key").agg(F.min(F.struct("created_at", "id", "row")).alias("first")), "first-members")
    members = materialize(slim.select("id", "key").join(firsts, "key").select("id", F.col("first.id").alias("rep")), "class-members")
    return members, firsts.select("first.row", F.col("first.id").alias("rep"), "first.created_at"), sets.select("row", "grp", "words")


def _levels(hashed: DataFrame) -> np.ndarray:
    """How common the tokens of each of _BUCKETS buckets are, as 4 times the binary logarithm; 0: they occur once at most.

    Any order of the tokens finds all pairs; the rarer come first, the fewer candidates. So tokens may
    share a bucket, and the table has a bound that no input moves.
    """
    counts = hashed.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(_BUCKETS)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    told = counts.where("n > 1").select((F.col("bucket") / 4096).cast("int").alias("part"), F.struct((F.col("bucket") % 4096).cast("short").alias("at"), F.ceil(4 * F.log2("n")).cast("byte").alias("level")).alias("c"))
    levels = np.zeros(_BUCKETS, np.uint8)
    for batch in told.groupBy("part").agg(F.collect_list("c").alias("c")).toArrow().to_batches():
        cells, part = batch.column("c"), batch.column("part").to_numpy().astype(np.int64)
        flat = cells.flatten()
        at = np.repeat(part, np.diff(cells.offsets.to_numpy())) * 4096 + flat.field("at").to_numpy()
        levels[at] = flat.field("level").to_numpy()
    return levels


def _rarest(threshold: float, shared: Broadcast):
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first tokens of each set by rarity with their positions; those that no other set can have are left out."""
        for b in batches:
            lists = b.column("h")
            h, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(n)), n)
            level = shared.value[h & (_BUCKETS - 1)]
            order = np.lexsort((h, level, of))
            h, level = h[order], level[order]
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + MET - 1
            keep = (pos <= np.repeat(most, n)) & (level > 0)
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(of[keep], minlength=len(n)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(h[keep])), pa.ListArray.from_arrays(cuts, pa.array(pos[keep], pa.int32()))],
                names=["row", "n", "h", "pos"],
            )

    return rarest


def similar_classes(classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later, jaccard) of the representatives of one group whose token sets reach ``threshold``.

    Sets x and y at Jaccard t have at least a = ceil(t / (1 + t) (|x| + |y|)) tokens in common. Ordered by
    rarity, the first k of these are among the first |x| - a + k of x, and likewise of y (for k = 1,
    Bayardo et al. 2007). Pairs that do not meet at MET tokens there, or at all ``a``, go before any
    token is compared; what meets are numbers of rows and hashes of tokens, and tokens of the pairs that
    are left decide.
    """
    hashed = sets.select("row", F.transform(F.split("words", " "), lambda t: F.xxhash64("grp", t)).alias("h"))
    levels = sets.sparkSession.sparkContext.broadcast(_levels(hashed))
    prefix = hashed.mapInArrow(_rarest(threshold, levels), "row long, n int, h array<long>, pos array<int>").where(F.size("h") > 0)
    prefix = prefix.join(classes.select("row"), "row", "left_semi").select("row", "n", F.explode(F.arrays_zip("h", "pos")).alias("t"))
    prefix = materialize(prefix.select("row", "n", "t.h", "t.pos"), "prefixes")
    a, b = prefix.toDF("a", "na", "h", "pa"), prefix.toDF("b", "nb", "h", "pb")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    first = (F.col("pa") < F.col("na") - least + MET) & (F.col("pb") < F.col("nb") - least + MET)
    met = a.join(b, "h").where(larger & (F.col("nb") >= threshold * F.col("na") - 1e-9) & first)
    met = met.select("a", "b", F.least(least, F.lit(MET)).cast("byte").alias("need")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    met = materialize(met.where("n >= need").select("a", "b"), "met-sets")
    drop_table(prefix)
    asked = met.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    told = materialize(sets.join(asked, "row", "left_semi").join(classes, "row").select("row", "rep", "created_at", "words"), "met-words")
    # the smaller set goes to the larger
    both = met.join(told.select(F.col("row").alias("b"), F.col("words").alias("wb")), "b").join(told.select(F.col("row").alias("a"), F.col("words").alias("wa")), "a")
    both = both.select("a", "b", F.size(F.array_intersect(F.split("wa", " "), F.split("wb", " "))).alias("both"))
    # written, as the filter would count them once more
    both = materialize(both, "met-tokens")
    size = told.select("row", "rep", "created_at", (F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1).alias("n"))
    side = lambda x: size.toDF(x, f"r{x}", f"c{x}", f"n{x}")
    checked = both.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("jaccard") >= threshold)
    first = F.struct("ca", "ra") < F.struct("cb", "rb")
    return checked.select(F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("earlier"), F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("later"), "jaccard")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later, jaccard): pairs between class representatives, and each further member of a class with its representative.

    With the members' lines this tells all pairs; they are not expanded, as copies in thousands would
    give millions.
    """
    members, classes, sets = token_classes(rows)
    copies = members.where("id <> rep").select(F.col("rep").alias("earlier"), F.col("id").alias("later"), F.lit(1.0).alias("jaccard"))
    pairs = similar_classes(classes, sets, threshold)
    drop_table(sets)
    return pairs.unionByName(copies)


def greedy(pairs: DataFrame) -> DataFrame:
    """(id, seed): of all rows in ``pairs``, in order, a row is accepted unless an accepted earlier one matches it.

    ``seed`` is the earliest accepted match, or the row itself where it is accepted. Rounds to the
    fixpoint: a row is settled once all its earlier matches are, or one of them is accepted.
    """
    pairs = materialize(pairs.select("earlier", "later"), "pairs")
    ids = pairs.select(F.col("earlier").alias("id")).unionByName(pairs.select(F.col("later").alias("id"))).distinct()
    state = materialize(ids.withColumn("accepted", F.lit(None).cast("boolean")), "greedy")
    while True:
        told = pairs.join(state.withColumnRenamed("id", "earlier"), "earlier").groupBy(F.col("later").alias("id"))
        around = told.agg(F.bool_or(F.coalesce("accepted", F.lit(False))).alias("hit"), F.bool_or(F.col("accepted").isNull()).alias("waits"))
        joined = state.join(around, "id", "left")
        now = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = materialize(joined.select("id", F.coalesce("accepted", now).alias("accepted")), "greedy")
        if state.where("accepted IS NULL").isEmpty():
            break
    seeds = state.where("accepted").select(F.col("id").alias("earlier"))
    owner = pairs.join(seeds, "earlier").groupBy(F.col("later").alias("id")).agg(F.min("earlier").alias("owner"))
    return state.join(owner, "id", "left").select("id", F.when(F.col("accepted"), F.col("id")).otherwise(F.col("owner")).alias("seed"))


def near_duplicates(rows: DataFrame, threshold: float = SAVE_THRESHOLD, among: DataFrame | None = None) -> DataFrame:
    """(id, matched_id, jaccard) of the rows (of those with ids in ``among``) that a save in order of arrival would skip.

    Only representatives can be accepted, so the fold runs over classes: a further member of a class is
    skipped for what its representative matched, or for the representative where that was accepted.
    """
    members, classes, sets = token_classes(rows, among)
    pairs = similar_classes(classes, sets, threshold)
    drop_table(sets)
    pairs = materialize(pairs, "near-pairs")
    skipped = greedy(pairs).where("id <> seed").select(F.col("id").alias("later"), F.col("seed").alias("earlier"))
    skipped = materialize(skipped.join(pairs, ["earlier", "later"]).select(F.col("later").alias("rep"), F.col("earlier").alias("matched_id"), "jaccard"), "skipped-classes")
    told = members.join(skipped, "rep", "left").where((F.col("id") != F.col("rep")) | F.col("matched_id").isNotNull())
    return told.select("id", F.coalesce("matched_id", "rep").alias("matched_id"), F.round(F.coalesce("jaccard", F.lit(1.0)), 6).alias("jaccard"))


def suggest_duplicates(rows: DataFrame, threshold: float = SUGGEST_THRESHOLD) -> DataFrame:
    """(seed_id, id, jaccard) of clusters of two or more; members are scored against their seed."""
    if threshold > 1:
        raise ValueError("threshold must be in (0, 1]")
    threshold = threshold if threshold > 0 else SUGGEST_THRESHOLD
    found = near_duplicates(rows, threshold)
    members = found.select(F.col("matched_id").alias("seed_id"), "id", "jaccard")
    return members.unionByName(members.select("seed_id", F.col("seed_id").alias("id"), F.lit(1.0).alias("jaccard")).distinct())
