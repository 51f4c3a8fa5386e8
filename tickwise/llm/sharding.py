"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

Everything here is DataFrame functions. The nodes of a level and their histograms are tables too: the driver only
learns how many nodes are still to be cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.shared import Shared, materialize

from .numbering import running

#: Histogram cells in one pass over all nodes of a level, and of one node at least.
CELLS, LEAST_CELLS = 32_768, 16
#: A dimension is scaled to so many bits; a hash of the row breaks ties below it.
SCALE_BITS, TIE_BITS = 31, 31
#: Equal rows that one task numbers.
EQUAL = 1 << 16


def _text_rank(name: str) -> Column:
    """A long that follows the byte order of a string's first seven bytes; null sorts first."""
    head = F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1))


def _scaled(bounds: list[tuple[int, int]], dims: list[str]) -> list[Column]:
    out = []
    for name, (lo, hi) in zip(dims, bounds):
        span = max(1, hi - lo)
        out.append(F.floor((F.col(name).cast("double") - lo) / span * ((1 << SCALE_BITS) - 1)).cast("long"))
    return out


def kd_shards(meta: DataFrame, dims: list[str], weight: str, tie: str, shards: int | None = None, target: int | None = None) -> DataFrame:
    """Adds ``node``, the leaf 0 .. n-1 of each row, so that leaves weigh about the same.

    Give ``shards``, or a ``target`` weight from which their number follows (the total over it, rounded up).
    A node that stands for k leaves is cut where its weight divides as k // 2 to k - k // 2, at the exact weighted
    quantile of (dimension, tie hash), along the dimension whose range in the node is widest next to its range in
    the whole table. The quantile is found by histograms that narrow to one key, so even a dimension in which a
    third of the rows agree is cut to within one row. ``meta`` should be cheap to rescan: it is read a few times
    a level, and each level is written, a few numbers a row. A level has a job or two more than passes, whatever the number
    of shards. dims are non-null longs. Rows that agree in ``tie`` too can't be told apart. An empty table gives no rows.
    """
    stats = meta.agg(F.sum(weight).alias("w"), F.count("*").alias("n"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    if not stats["n"]:
        return meta.withColumn("node", F.lit(0))
    n_shards = shards or max(1, -(-int(stats["w"]) // target))
    scaled = _scaled([(stats[f"lo_{d}"], stats[f"hi_{d}"]) for d in dims], dims)
    spread = F.pmod(F.col(tie), F.lit(1 << TIE_BITS))
    keys = [f"__k{i}" for i in range(len(dims))]
    keyed, held = meta.withColumns({k: s * (1 << TIE_BITS) + spread for k, s in zip(keys, scaled)}).withColumn("node", F.lit(0).cast("long")), None
    # a node is named by the first of its leaves
    nodes = meta.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(n_shards).cast("long").alias("leaves"))
    for _ in range((n_shards - 1).bit_length()):
        # written level by level: nested, the choice of a node would be a plan that grows with the depth
        cuts = _weighted_quantiles(keyed, keys, weight, _axes(keyed, nodes, keys, weight))
        nodes = nodes.where("leaves = 1").unionByName(cuts.select(F.explode(F.array(F.struct("node", F.col("half").alias("leaves")), F.struct((F.col("node") + F.col("half")).alias("node"), (F.col("leaves") - F.col("half")).alias("leaves")))).alias("x")).select("x.*"))
        chosen = F.element_at(F.array(*keys), F.col("axis") + 1)
        moved = keyed.join(cuts.select("node", "axis", "half", "cut"), "node", "left").withColumn("node", F.col("node") + F.when(chosen > F.col("cut"), F.col("half")).otherwise(0))
        level = Shared(moved.drop("axis", "half", "cut"))
        if held is not None:
            held.drop()
        keyed, held = level.df, level
    return keyed.withColumn("node", F.col("node").cast("int")).drop(*keys)


def _axes(keyed: DataFrame, nodes: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The nodes to cut, each with its axis, the bounds of its keys there, and the weight that its first half should get."""
    wide = keyed.groupBy("node").agg(F.sum(weight).alias("w"), F.array(*[F.min(k) for k in keys]).alias("lo"), F.array(*[F.max(k) for k in keys]).alias("hi"))
    range_of = F.transform(F.arrays_zip("lo", "hi"), lambda x: x["hi"] - x["lo"])
    live = nodes.where("leaves > 1").join(wide, "node").withColumn("half", F.expr("leaves div 2")).withColumn("__d", range_of)
    axis = (F.array_position("__d", F.array_max("__d")) - 1).cast("int")
    return live.withColumn("axis", axis).select(
        "node", "leaves", "half", "axis", F.element_at("lo", F.col("axis") + 1).alias("lo"), F.element_at("hi", F.col("axis") + 1).alias("hi"),
        (F.col("w") * F.col("half") / F.col("leaves")).alias("goal"), F.lit(0.0).alias("below"), F.lit(None).cast("long").alias("cut"),
    )


def _weighted_quantiles(keyed: DataFrame, keys: list[str], weight: str, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``cut``: the key up to which a node's weight comes nearest to its goal.

    Each pass cuts every open interval into equal cells, sums weights per cell (map-side first), and keeps the
    cell in which the goal falls, shrunk to the keys that are there. A node is done when that is one key.
    """
    columns = nodes.columns
    done, open_ = [], materialize(nodes)
    while n := open_.count():
        cells = max(LEAST_CELLS, CELLS // n)
        asked = open_.withColumn("width", F.expr(f"greatest(1L, (hi - lo) div {cells} + 1)")).drop("cut")
        rows = keyed.select("node", *keys, F.col(weight).alias("weight")).join(asked, "node").withColumn("key", F.element_at(F.array(*keys), F.col("axis") + 1))
        own = [c for c in columns if c not in ("lo", "hi", "cut")]
        cell = F.expr("(key - lo) div width")
        hist = rows.where("key between lo and hi").groupBy(*own, cell.alias("cell")).agg(F.sum("weight").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        by = W.partitionBy("node").orderBy("cell")
        passed = hist.withColumns({"at": F.col("below") + F.sum("w").over(by), "prior": F.lag("hi").over(by), "next": F.lead("cell").over(by)})
        first = passed.where("at >= goal or next is null").groupBy(*own).agg(F.min(F.struct("cell", "at", "w", "lo", "hi", "prior")).alias("x")).select(*own, "x.*")
        nearer = F.abs(F.col("at") - F.col("w") - F.col("goal")) < F.abs(F.col("at") - F.col("goal"))
        cut = F.when(F.col("lo") == F.col("hi"), F.when(nearer, F.coalesce("prior", F.col("lo") - 1)).otherwise(F.col("lo")))
        found = materialize(first.withColumn("cut", cut).withColumn("below", F.col("at") - F.col("w")).select(*columns))
        done.append(found.where("cut is not null"))
        open_ = found.where("cut is null")
    return reduce(DataFrame.unionByName, done) if done else open_


def _equal_rows_apart(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, which numbers equal rows from 0. They meet as one row with a count, and many of them part in several tasks."""
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")))
    few = counted.where(f"__n <= {EQUAL}").withColumn("__block", F.lit(0).cast("long"))
    many = counted.where(f"__n > {EQUAL}").withColumn("__block", F.explode(F.expr(f"sequence(0L, (__n - 1) div {EQUAL})"))).repartition("__block", *rows.columns)
    number = F.expr(f"explode(sequence(__block * {EQUAL}, least(__n, (__block + 1) * {EQUAL}) - 1))")
    return few.unionByName(many).select(*rows.columns, number.alias(name))


def shard_documents(docs: DataFrame, shards: int | None = None, target: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra_dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, crc, shard, slot): every row in a shard of near-equal bytes, numbered from 0 without gaps there.

    Dimensions: the strings in ``extra_dims`` that the table has, text size, id. size is the text's UTF-8 bytes plus
    8; a null text counts no bytes and has the crc32 of no bytes. Null ids and dimensions sort first. Repeated
    rows stay, each with its own slot, and part like any others. The shards' sizes differ by about the largest row at
    most. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    names = [c for c in extra_dims if c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), *[_text_rank(c).alias(f"dim_{i}") for i, c in enumerate(names)])
    copies = _equal_rows_apart(own, "copy")
    meta = materialize(copies.withColumns({"dim_size": F.col("size"), "dim_id": F.coalesce("id", F.lit(-1)), "tie": F.xxhash64("id", "crc", "copy")}).drop("copy"))
    dims = [*[f"dim_{i}" for i in range(len(names))], "dim_size", "dim_id"]
    placed = kd_shards(meta, dims, "size", "tie", shards, target).select("id", "size", "crc", F.col("node").alias("shard"), "tie")
    numbered = running(placed, "shard", F.pmod(F.xxhash64("tie"), F.lit(1 << 31)), F.lit(1).cast("long"), "slot", meta.count(), ["id", "size", "crc"])
    return numbered.select("id", "size", "crc", "shard", "slot")
