"""The shared pool: JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import store as S
from lessonlake.sources.shared import materialize

FIELDS = ("kind", "task_type", "title", "what", "learned", "tags")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of any length."""
    return spark.read.text(path)


def verdicts(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Per line that is not blank: imported, skipped (known or repeated) or failed; with its parsed fields.

    Bad JSON and failed validation never stop the import. Every row becomes shared.
    """
    schema = ", ".join(f"{f} string" for f in FIELDS)
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = parsed.select("value", *[F.col(f"r.{f}").alias(f) for f in FIELDS], F.col("r._bad").isNotNull().alias("bad"))
    rows = rows.withColumns({"scope": F.lit("shared"), "origin": F.lit("manual"), "session_id": F.lit("")})
    rows = rows.withColumn("error", F.when(F.col("bad"), "line:json").otherwise(S.validation_error()))
    rows = rows.withColumn("fingerprint", T.fingerprint(*[F.col(c) for c in ("task_type", "kind", "title", "learned")]))
    rows = materialize(rows.withColumn("line", F.monotonically_increasing_id()), "pool-lines")
    # both lists are written before their join, which can so split a fingerprint of many lines
    known = materialize(stored.select("fingerprint", F.lit(True).alias("known")).distinct(), "pool-known")
    first = materialize(rows.where("error IS NULL").groupBy("fingerprint").agg(F.min("line").alias("first")), "pool-first")
    rows = rows.join(known, "fingerprint", "left").join(first, "fingerprint", "left")
    verdict = F.when(F.col("error").isNotNull(), "failed").when(F.col("known") | (F.col("line") != F.col("first")), "skipped").otherwise("imported")
    return rows.withColumn("verdict", verdict).drop("known", "bad", "line", "first")
