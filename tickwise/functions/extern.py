"""Functions of one's own, and of Python's libraries, in rules: registered by name, run on Arrow batches."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def extern(spark: SparkSession, name: str, function: Callable[..., pd.Series], kind: str) -> None:
    """Makes a function of pandas series, pure by declaration, usable in the SQL of guards, lets and heads as ``name``."""
    spark.udf.register(name, F.pandas_udf(function, kind))


def _each(one: Callable[[bytes], bytes | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else one(bytes(b)))

    return run


def _or_none(one: Callable[[bytes], bytes]) -> Callable[[bytes], bytes | None]:
    def run(data: bytes) -> bytes | None:
        try:
            return one(data)
        except (OSError, EOFError, zlib.error, zstandard.ZstdError):
            return None

    return run


def gzip_(data: Column) -> Column:
    return _each(lambda b: gzip.compress(b, mtime=0))(data)


def gunzip(data: Column) -> Column:
    """The content, or null if the data is no gzip."""
    return _each(_or_none(gzip.decompress))(data)


def zstd(data: Column, level: int = 3) -> Column:
    return _each(lambda b: zstandard.ZstdCompressor(level=level).compress(b))(data)


def unzstd(data: Column, most: int = 1 << 26) -> Column:
    """The content, up to ``most`` bytes, or null if the data is no Zstandard frame."""
    return _each(_or_none(lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=most)))(data)
