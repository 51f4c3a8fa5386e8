"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of the types above."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_columns(df: DataFrame, step: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, Any]]], ddl: str) -> DataFrame:
    """mapInArrow over dicts of columns; ``step`` sees a whole partition as an iterator of batches, so it can keep bounded state."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dicts = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for out in step(dicts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all of ``taken``, which Spark compares without case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: decides the fold of a labelled row. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
