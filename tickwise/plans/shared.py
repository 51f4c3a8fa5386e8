"""Tables in the folder that driver and executors share, to cut lineage.

A written table survives the loss of any executor, and its file statistics tell
Catalyst how large it really is, which a checkpointed RDD cannot. Tables lie in a folder of the session, which
goes when the driver's JVM ends; those that must outlive it ask for ``keep``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, about.
BUCKET_ROWS = 50_000

_local_dir: str | None = None
_session_dirs: dict[str, str] = {}
_scopes: list[list[Shared]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local runs that set none."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return f"file://{_local_dir}"


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def session_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared folder, deleted when the driver's JVM ends."""
    shared, app = shared_dir(spark), spark.sparkContext.applicationId
    if f"{shared} {app}" not in _session_dirs:
        path = f"{shared}/session-{uuid.uuid4().hex}"
        found, fs = _hadoop_path(spark, path)
        fs.mkdirs(found)
        fs.deleteOnExit(found)
        _session_dirs[f"{shared} {app}"] = path
    return _session_dirs[f"{shared} {app}"]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside go at the end, but for those that a ``Shared`` with ``result`` holds: for steps with one small result."""
    _scopes.append([])
    try:
        yield
    finally:
        for t in _scopes.pop():
            t.drop()


class Shared:
    """A table written to the shared folder, with the DataFrame that reads it back."""

    def __init__(self, df: DataFrame, keep: bool = False, result: bool = False):
        self.spark = df.sparkSession
        if _scopes and not keep and not result:
            _scopes[-1].append(self)
        self.path = f"{shared_dir(self.spark) if keep else session_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema) -> Shared:
        """The table that was written to ``path`` before, perhaps by another session."""
        held = cls.__new__(cls)
        held.spark, held.path, held.df = spark, path, spark.read.schema(schema).parquet(path)
        return held

    def drop(self) -> None:
        """Remove the files; only for tables that no later plan reads."""
        path, fs = _hadoop_path(self.spark, self.path)
        fs.delete(path, True)


class Bucketed:
    """Rows in hash buckets of their column ``__key``, a struct, in which nulls are equal.

    A join on ``__key`` reads the buckets as they lie: only the other side is shuffled. The table's name in the session's
    catalogue is only for that; ``forget`` drops it and leaves the files, which ``plain`` reads.
    """

    def __init__(self, df: DataFrame, rows: int = 0):
        """``rows`` is about how many there will be: there are as many buckets as shuffle partitions, or fewer for a small table."""
        self.spark = df.sparkSession
        self.path, self.name = f"{session_dir(self.spark)}/t-{uuid.uuid4().hex}", f"tickwise_{uuid.uuid4().hex}"
        buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), max(8, 1 << (rows // BUCKET_ROWS).bit_length()))
        df.write.bucketBy(buckets, "__key").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.df, self.plain = self.spark.table(self.name), self.spark.read.schema(df.schema).parquet(self.path)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.forget()
        path, fs = _hadoop_path(self.spark, self.path)
        fs.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the frame that reads it."""
    return Shared(df).df
