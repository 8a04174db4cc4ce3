"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pivots import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import digests, format_conversations

    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_conversations(turns.unionByName(own)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.blocks import deduplicate_words

    return deduplicate_words(table(spark, sf_dir, "documents"), window=13).drop("spans")


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pieces import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"))


def op9_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import deduplicate_bytes

    return deduplicate_bytes(table(spark, sf_dir, "documents"), window=50).drop("spans")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by source, one of them large, to eight of near-equal bytes, as files."""
    from tidemark.llm.resharding import reshard, rewritten

    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(6))
    placed = reshard(table(spark, sf_dir, "documents"), old, 8)
    placed = rewritten(placed, f"{checkpoint_dir(spark)}/reshard-{uuid.uuid4().hex}")
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import oracles

    return oracles.oracle_sql()
