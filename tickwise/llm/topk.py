"""Exact top-k inner products by a vector-approximation file.

Each vector is kept twice: exactly, and as a cell number per component. A scan of the cells alone bounds every
score from below and above. The k-th best lower bound is a floor that drops nearly all vectors; the exact vectors of
the rest are read in the order of their upper bounds, a slice of the order a round, until the k-th result cannot change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.shared import materialize

from .common import map_columns

CELLS = 256
#: Bytes of query vectors that are broadcast at a time, and blocks of them that are scanned in one job.
QUERY_BYTES, BLOCKS = 8 << 20, 8
#: Exact vectors that a query reads in the first round; each round reads GROWTH times as many as the one before.
FIRST, GROWTH = 16, 4


def scaled(rows: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): components as floor(scale * x). Null vectors, null or non-finite components and null ids drop out."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _marks(exact: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the low mark and the cell width of each component, over all vectors: a row a component."""

    def step(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for v in b["v"]:
                a = np.array(v, np.float64)
                lo, hi = seen.get(len(a), (a, a))
                seen[len(a)] = (np.minimum(lo, a), np.maximum(hi, a))
        for d, (lo, hi) in seen.items():
            yield {"d": [d] * d, "at": list(range(d)), "lo": lo, "hi": hi}

    rows = map_columns(exact.select("v"), step, "d int, at int, lo double, hi double").groupBy("d", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows:
        lo, width = out.setdefault(r["d"], (np.zeros(r["d"]), np.zeros(r["d"])))
        lo[r["at"]], width[r["at"]] = r["lo"], max((r["hi"] - r["lo"]) / CELLS, 1e-9)
    return out


def _bounds(cells: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole numbers that the cells' components can be, widened for rounding."""
    slack = 1e-9 * (np.abs(lo) + width * CELLS) + 1e-6
    return np.ceil(lo + cells * width - slack), np.floor(lo + (cells + 1.0) * width + slack)


def _cells(v: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((v - lo) / width), 0, CELLS - 1).astype(np.uint8)


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact inner product of whole numbers, kept within a long."""
    if len(a) == 0:
        return 0
    if float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * len(a) < 2.0**62:
        return int(a @ b)
    exact = sum(int(x) * int(y) for x, y in zip(a, b))
    return max(-(1 << 63), min((1 << 63) - 1, exact))


def top_k(rows: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` (a condition on column id) the k best other ids.

    Scores are inner products of the scaled whole-number vectors; ties go to the smaller id; fewer than k rows give
    all. Vectors of other lengths than the query's do not compare. Rows that repeat an id and vector count once, and
    an id is never its own result. Equal vectors are scanned once: the smallest k + 1 ids of a vector are all that
    can be among the best k of any query, so a vector that a third of the rows share costs no more than another.
    Null vectors, vectors with null or non-finite components and null ids take no part, an empty table gives no rows, and
    other columns, whatever their names, are ignored.
    """
    known = materialize(scaled(rows, id_col, vec_col, scale).distinct())
    first = known.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    exact = materialize(first.groupBy("v").agg(F.min("id").alias("vid"), F.array_sort(F.collect_list("id")).alias("ids")))
    asked = materialize(known.where(is_query).join(exact.select("v", "vid"), "v").select("id", "vid"))
    marks = _marks(exact)

    def approximate(batches):
        for b in batches:
            cells = [_cells(np.array(v, np.float64), *marks[len(v)]).tobytes() if v else b"" for v in b["v"]]
            yield {"vid": b["vid"], "d": [len(v) for v in b["v"]], "cells": cells}

    va = materialize(map_columns(exact.select("vid", "v"), approximate, "vid long, d int, cells binary"))
    queries = materialize(asked.select("vid").distinct().join(exact, "vid").select(F.col("vid").alias("qid"), F.col("v").alias("q")))
    near = [materialize(reduce(DataFrame.unionByName, some)) for some in _scans(va, queries, marks, k + 1)]
    best = _refined(reduce(DataFrame.unionByName, near) if near else va.select(F.col("vid").alias("qid"), "vid", F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).limit(0), exact, queries, k + 1)
    mine = asked.select(F.col("id").alias("query_id"), F.col("vid").alias("qid")).join(best, "qid").where("query_id <> id")
    ranked = mine.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _scans(va: DataFrame, queries: DataFrame, marks: dict, keep: int) -> Iterator[list[DataFrame]]:
    """For each block of queries a scan of all cells: (qid, vid, low, high) of what a task could not rule out.

    The cells stay where they are; a block of queries, of bounded bytes, is broadcast to them, and only survivors are written.
    """
    sc = va.sparkSession.sparkContext
    size = queries.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    blocks, some = -(-int(size) // QUERY_BYTES), []
    for n in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).toArrow()
        asking: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(q) for q in rows["q"]])
        for d in np.unique(lengths) if len(lengths) else ():
            at = np.flatnonzero(lengths == d)
            asking[int(d)] = rows["qid"].to_numpy()[at], np.array([rows["q"][int(i)].as_py() for i in at], np.float64).reshape(len(at), d)
        some.append(_scan(va, sc.broadcast(asking), marks, keep))
        if len(some) == BLOCKS:
            yield some
            some = []
    if some:
        yield some


def _scan(va: DataFrame, asking, marks: dict, keep: int) -> DataFrame:
    schema = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((len(qid), keep), -np.inf) for d, (qid, _) in asking.value.items()}
        found: dict[int, list] = {d: [] for d in best}
        for b in batches:
            vids, ds, cells = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for d, (_, q) in asking.value.items():
                mine = np.flatnonzero(ds == d)
                for a in range(0, len(mine), 1024):
                    at = mine[a : a + 1024]
                    part = np.frombuffer(b"".join(cells[int(i)].as_py() for i in at), np.uint8).reshape(len(at), d)
                    lo, hi = _bounds(part, *marks[d]) if d else (part.astype(float), part.astype(float))
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    low, high = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
                    big = np.abs(high) > 2.0**52
                    low, high = np.where(big, low - np.abs(low) * 1e-9, low), np.where(big, high + np.abs(high) * 1e-9, high)
                    best[d] = -np.partition(-np.concatenate([best[d], low], axis=1), keep - 1, axis=1)[:, :keep]
                    which, hit = np.nonzero(high >= best[d].min(axis=1)[:, None])
                    found[d].append((which, vids[at[hit]], low[which, hit], high[which, hit]))
        for d, parts in found.items():
            if parts:
                which, vid, low, high = (np.concatenate(x) for x in zip(*parts))
                still = high >= best[d].min(axis=1)[which]
                columns = asking.value[d][0][which[still]], vid[still], low[still], high[still]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return va.mapInArrow(step, "qid long, vid long, low double, high double")


def _refined(near: DataFrame, exact: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(qid, id, score): each query's ``keep`` best. Rounds read slices of the candidates in the order of their upper bounds.

    A query is done when the next upper bound is under its last score; others go on with a slice GROWTH times as long.
    """
    floor = near.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.col("low").desc(), "vid"))).where(F.col("n") == keep).select("qid", F.col("low").alias("floor"))
    left_over = near.join(floor, "qid", "left").where("floor is null or high >= floor")
    ranked = materialize(left_over.select("qid", "vid", "high", F.row_number().over(W.partitionBy("qid").orderBy(F.col("high").desc(), "vid")).alias("n")))
    best = materialize(queries.limit(0).select("qid", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")))
    done, upto = 0, FIRST

    def scored(batches):
        for b in batches:
            yield {"qid": b["qid"], "ids": b["ids"], "score": [dot(np.array(q, np.int64), np.array(v, np.int64)) for q, v in zip(b["q"], b["v"])]}

    while True:
        last = best.groupBy("qid").agg(F.count("*").alias("have"), F.min("score").alias("last"))
        open_ = ranked.where(F.col("n") > done).join(last, "qid", "left").where((F.coalesce("have", F.lit(0)) < keep) | (F.col("high") >= F.col("last")))
        asked = materialize(open_.where(F.col("n") <= upto).select("qid", "vid"))
        if asked.isEmpty():
            if done and open_.isEmpty():
                return best
            if not done and ranked.isEmpty():
                return best
        read = asked.join(exact, "vid").join(queries, "qid").select("qid", "ids", "q", "v")
        new = map_columns(read, scored, "qid long, ids array<long>, score long").select("qid", F.explode("ids").alias("id"), "score")
        both = best.unionByName(new)
        order = W.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        best = materialize(both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n"))
        done, upto = upto, upto * GROWTH
