"""The corpus pipeline: its stages, one after the other, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents. The last returns where each row goes.

For every stage: an empty table stays empty, texts of any length count whole, columns beside doc_id, text, source and lang
may have any name and pass through, and no stage fails at nulls. What nulls and repeated rows mean is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import decontaminate, mixing, quality, sharding, simhash
from tickwise.llm.common import table
from tickwise.plans.shared import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker scores above its cut.

    A null text scores as an empty one; null ids neither teach nor matter; rows that repeat stay or go together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=~quality.held_out("id"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    Rows go by id and text: of rows that repeat both one stays, and a text of its own stays under any id. Null and empty texts
    are copies of each other; rows without an id stay.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null texts hold none; rows that repeat stay or go together."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, in the curriculum's order.

    A null source is a source of its own, null texts have no words and are taken once, rows that repeat an id are taken alike,
    ties in position go by id.
    """
    return mixing.copies(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: 24 shards of near-equal bytes.

    Null texts have no bytes, null ids and sources sort first, rows that repeat part like any others.
    """
    return sharding.shard_documents(docs, shards=24).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]

#: SQL can express neither the trained ranker nor the fingerprints; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
