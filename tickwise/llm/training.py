"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, t, y) of at most ``per_class`` rows of each class, and how many labelled rows each class has.

    ``learn`` says which ids may teach. Ids are taken in the order of their hash, so reruns agree. The counts are over
    all labelled rows that may teach, sample or not. Rows whose text exceeds ``max_bytes`` don't teach, so the sample's
    size is bounded by 2 * per_class * max_bytes. Null ids and labels other than 0 and 1 don't teach; of repeated
    labels of an id the largest counts. The ids, bounded, are broadcast; documents are scanned once.
    """
    teach = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).where(learn).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in teach.groupBy("y").count().collect()}
    picked = [r.asDict() for y in (0, 1) for r in teach.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    ids = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.octet_length("t") <= max_bytes)
    return texts.join(F.broadcast(ids), "id"), counts
