"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, tau=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _scored(found: DataFrame, held_out) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out("id"))
    return _scored(toxicity.score(docs, model), toxicity.held_out)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=~quality.held_out("id"))
    return _scored(quality.score(docs, model), quality.held_out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, schedule

    passes = schedule(mix(table(spark, sf_dir, "documents")))
    first = passes.where("pass is null or pass = 0")
    return first.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("position").alias("first_position"), F.col("place").alias("first_place"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_edits, sample_edits

    vocabulary = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
    found = count_edits(table(spark, sf_dir, "documents"), sample_edits(), vocabulary)
    return found.withColumnRenamed("id", "doc_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted

    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    found = formatted(rows.unionByName(planted))
    return found.withColumnRenamed("conv", "conv_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import digest, remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), finish=digest)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_tokens": op7_tokens,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op10_substrings": op10_substrings,
}

def oracles() -> dict[str, str]:
    from . import mixing

    return {"op6_mixing": mixing.ORACLE}
