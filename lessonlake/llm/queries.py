"""One thin query for each operator: whole tables in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lessonlake.llm import bpe, ctw, mixing, pii, simhash, substring, topk_bits, toxicity, vptree, warc
from lessonlake.llm._shared import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_topk_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bits.top_k(read_table(spark, sf_dir, "embeddings"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(read_table(spark, sf_dir, "documents"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(read_table(spark, sf_dir, "documents"))
