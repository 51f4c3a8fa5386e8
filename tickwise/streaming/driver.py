"""The tick driver over Structured Streaming: a micro-batch is a tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwise.plans.ticks import Ticks


def run_stream(source: DataFrame, event: str, ticks: Ticks, checkpoint: str, **trigger) -> StreamingQuery:
    """Feeds each micro-batch as one tick's ``event``. A batch that a restart repeats is not applied twice.

    Give ``ticks`` a journal for that to hold across sessions, too.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if batch_id > ticks.batch:
            ticks.advance({event: rows}, batch_id)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sealed(received: DataFrame, expected: DataFrame, key: tuple[str, ...], count: str) -> DataFrame:
    """Keys whose sealed row count has arrived in full."""
    have = received.groupBy(*key).agg(F.count("*").alias("__have"))
    return expected.join(have, list(key)).where(F.col(count) == F.col("__have")).select(*key)


def windowed_counts(stream: DataFrame, at: str, key: str, late: str, width: str) -> DataFrame:
    """Counts per event-time window; state older than the watermark is dropped. A native extra, without a counterpart."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
