"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lessonlake.llm import mixing, topk_bits, vptree, warc
from lessonlake.llm import queries as q

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": q.op1_mixing,
        "op2_simhash": q.op2_simhash,
        "op3_topk_bits": q.op3_topk_bits,
        "op4_substring": q.op4_substring,
        "op5_toxicity": q.op5_toxicity,
        "op6_warc": q.op6_warc,
        "op7_vptree": q.op7_vptree,
        "op8_ctw": q.op8_ctw,
        "op9_bpe": q.op9_bpe,
        "op10_pii": q.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE_SQL, "op3_topk_bits": topk_bits.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op7_vptree": vptree.ORACLE_SQL}
