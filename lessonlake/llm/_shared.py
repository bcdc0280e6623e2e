"""What the operators of this subpackage share: shared-folder tables, words, row digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.sources.shared import drop_table, filesystem, materialize, qualified, shared_dir, shared_path

__all__ = ["LOWER", "WORD", "drop_table", "filesystem", "held_out", "materialize", "packed", "qualified", "read_table", "shared_dir", "shared_path", "texts", "word_count"]

#: A word in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, name: str = "packed") -> Column:
    """All columns of ``docs`` as one struct, so that no name can clash with a helper's; names may hold dots and backticks."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias(name)


def texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch one after another, so that a batch is never held twice."""
    for t in batch.column("text"):
        yield t.as_py()


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` = 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))
