"""Text files as rows of numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.choice import index


def lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """(file, line, text), lines from 0 in each file. Large files are read in splits; the splits' counts make the numbers."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    if not numbered:
        return rows.select("file", "text")
    return index(rows, [F.col("__at").asc(), F.col("__id").asc()], "line", ("file",)).select("file", "line", "text")
