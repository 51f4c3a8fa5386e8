"""Relations named by a deployment's configuration."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def relations(spark: SparkSession, config: dict[str, dict[str, Any]]) -> dict[str, DataFrame]:
    """A frame per relation. An entry has ``rows`` and ``ddl``, or ``path`` with ``format`` (parquet if not given), ``options`` and ``columns``."""
    out = {}
    for name, entry in config.items():
        if "rows" in entry:
            out[name] = spark.createDataFrame([tuple(r) for r in entry["rows"]], entry["ddl"])
            continue
        rows = spark.read.format(entry.get("format", "parquet")).options(**entry.get("options", {})).load(entry["path"])
        out[name] = rows.select(*entry["columns"]) if "columns" in entry else rows
    return out
