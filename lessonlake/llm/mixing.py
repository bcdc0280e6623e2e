"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Keys fall into ``BUCKETS`` equal ranges, so the range sort of
one source is spread over that many groups however large the source is; bucket totals give each
range its base, and a running sum inside the range gives each document its exact start in its
source's random order. A source is read over in whole epochs and cut inside the last one at its
exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.llm._shared import WORD, materialize, packed, word_count

BUCKETS = 4096
WEIGHTS = (5, 2, 1)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, get the weights in turn. ``share`` (a fraction) of all sizes
    is dealt by weight; a target stops at ``most`` times its source and the excess is dealt anew by
    weight, until none is above. That is water filling: with sources ordered by size over weight,
    the first source that stays under its limit fixes the level. All sums are integers, so the only
    rounding is the last division. The windows without a partition see one row per source.
    """
    up, down = share
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("weight", weight)
    ranked = ranked.withColumns({
        "fill": F.row_number().over(full),
        "left": F.sum("source_size").over(everything) * up - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most * down,
        "sharing": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    free = F.col("source_size") * most * down * F.col("sharing") >= F.col("weight") * F.col("left")
    level = F.min(F.when(free, F.struct("fill", "left", "sharing"))).over(everything)
    ranked = ranked.withColumn("level", level)
    due = (F.col("weight") * F.col("level.left")).cast("double") / (F.col("level.sharing") * down).cast("double")
    return ranked.withColumn("target", F.least((F.col("source_size") * most).cast("double"), due)).select("source", "source_size", "target")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _sized(docs: DataFrame) -> DataFrame:
    """Adds size, the hash-random key, its range, and a source key that is never null.

    The key is a hash of id and text, so rows without an id, or with the same, spread over the ranges.
    Rows without words take no part in the order: they are dealt out by their place in the input.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    bucket = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * BUCKETS / 2**32).cast("int")
    sized = docs.withColumns({"size": word_count(F.col("text")), "key": digest, "skey": _source_key(F.col("source"))})
    return sized.withColumn("bucket", F.when(F.col("size") > 0, bucket).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int")))


def _placed(sized: DataFrame, narrow: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """``sized`` with source_size, target and taken; ``narrow`` has the same rows without their texts."""
    parts = narrow.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("part"))
    totals = parts.groupBy("skey").agg(F.first("source").alias("source"), F.sum("part").alias("source_size"))
    goal = targets(totals.select("source", "source_size"), weights, share, most).withColumn("skey", _source_key(F.col("source"))).drop("source")
    sofar = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("skey", "bucket", F.coalesce(F.sum("part").over(sofar), F.lit(0)).alias("base")).join(goal, "skey")

    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("end", F.sum("size").over(inside)).join(base, ["skey", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = F.floor("target") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("base") + F.col("end") - F.col("size"))))
    return placed.withColumn("taken", (epochs * F.col("size") + cut).cast("long"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs``.

    ``taken`` counts words, repeats included: whole epochs of the source plus the document's part
    of the last, cut epoch. A source's taken words sum to its target rounded down, and none exceeds
    ``most`` times its size. Null or empty texts have size 0 and take nothing; null sources form one
    source, the last; equal rows share a key and are interchangeable; other columns are ignored; an
    empty table gives no rows.
    """
    sized = materialize(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    return _placed(sized, sized, weights, share, most).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: one row for each time a document is taken.

    Only where a source's budget ends is a document cut, to its first words joined by one space.
    Documents that are not taken, and those without words, have no row. Null sources form one source,
    the last; repeated rows are each taken; all columns stay, whatever their names; an empty table
    gives no rows.
    """
    wide = docs.select(packed(docs, "row"), "doc_id", "source", "text").where(word_count(F.col("text")) > 0)
    narrow = docs.select("doc_id", "source", "text")
    placed = _placed(_sized(wide), _sized(narrow).drop("text"), weights, share, most)
    whole = F.array_repeat(F.col("size"), F.expr("cast(taken div size as int)"))
    part = F.expr("taken % size")
    times = F.when(part > 0, F.concat(whole, F.array(part))).otherwise(whole)
    taken = placed.where(F.col("taken") > 0).select("row", "size", F.explode(times).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), first).otherwise(F.col("row.text"))
    return taken.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER o AS fill,
         3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS sharing
  FROM totals
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST),
         b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT remaining, sharing FROM ranked WHERE source_size * 4 * sharing >= weight * remaining ORDER BY fill LIMIT 1),
goal AS (
  SELECT r.source, r.source_size,
         least((r.source_size * 2)::DOUBLE, (r.weight * l.remaining)::DOUBLE / (2 * l.sharing)::DOUBLE) AS target
  FROM ranked r CROSS JOIN level l),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS last_word,
         floor(g.target)::BIGINT AS budget,
         CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - (last_word - size))))::BIGINT AS taken
FROM placed
"""
