"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a schedule over training time. Its integral is the source's cumulative token demand;
inverting the demand at each document's place in its source's stream gives the document's training position,
and a range sort by position is the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.operators.parts import carried, dealt
from tickwise.plans.shared import materialize

from .common import WORD, fresh
from .numbering import running

#: A schedule: the weight's multiple at equally spaced times from 0 to 1, linear between. Sources take them in turn.
RAMPS = ((2.0, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 2.0))
WEIGHTS = (3, 1, 2)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, weight, source_size, target) for each source, sources by code point with null last.

    Sources share ``share`` of all sizes by weight. A target stops at ``most`` times its source's size and the
    excess is shared again by weight until none is above. The sources that stop are those of least room per
    weight, so sorting by that and summing from the front finds the level at which the rest are served: one
    window over a row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    room = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    front = room.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("cap").over(front), F.lit(0.0))) / F.sum("weight").over(room.rowsBetween(W.currentRow, W.unboundedFollowing))
    levelled = ranked.withColumn("__level", level).withColumn("__open", F.col("__level") <= F.col("cap") / F.col("weight"))
    # the first source that needs no cap sets the level for itself and all after it
    served = F.min(F.when(F.col("__open"), F.struct(F.col("cap") / F.col("weight"), "rank", "__level"))).over(W.partitionBy())
    target = F.when(served.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * served["__level"]))
    return levelled.withColumn("target", target).select("source", "rank", "weight", "source_size", "target")


def position(part: F.Column, ramp: F.Column, knots: int) -> F.Column:
    """The time in [0, 1] at which the schedule ``ramp`` has used the share ``part`` of its integral."""
    step = 1.0 / (knots - 1)
    area = sum(((ramp[i] + ramp[i + 1]) / 2 * step for i in range(knots - 1)), F.lit(0.0))
    want, found, before = part * area, F.lit(1.0), F.lit(0.0)
    pieces = []
    for i in range(knots - 1):
        piece = (ramp[i] + ramp[i + 1]) / 2 * step
        rise = (ramp[i + 1] - ramp[i]) / step
        rest = F.greatest(want - before, F.lit(0.0))
        # rest = ramp_i * x + rise * x^2 / 2, written so that it holds for a rise of zero too
        x = 2 * rest / (ramp[i] + F.sqrt(F.greatest(ramp[i] * ramp[i] + 2 * rise * rest, F.lit(0.0))))
        pieces.append((want <= before + piece, F.least(F.lit(i * step) + x, F.lit((i + 1) * step))))
        before = before + piece
    for when, value in reversed(pieces):
        found = F.when(when, value).otherwise(found)
    return found


def _stream_key(doc_id: F.Column) -> F.Column:
    """What a source's stream is ordered by."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, ramps: tuple[tuple[float, ...], ...] = RAMPS) -> DataFrame:
    """(id, source, size, source_size, target, taken, passes, first_position, before, ramp) of every row of ``docs``.

    size counts words. A source's stream is its documents in the order of md5(id), over and over; the mix takes its
    first ``target`` words, so a document is taken target // source_size times in whole and once more if it comes
    before the end; the one document at the end is taken in part, so that sources meet their targets to the word.
    first_position is where the curriculum first shows the document, null if nothing of it is taken; before counts the
    words ahead of it in a pass of its source's stream and ramp is the source's schedule.
    Null texts have no words; a null source is a source of its own; repeated rows each keep their place; empty
    tables give no rows. Running sums are made block by block, so a source may hold any share of the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    knots = len(ramps[0])
    shape = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in ramps]), (F.col("rank") % len(ramps) + 1).cast("int"))
    targets = materialize(source_targets(sized, weights, share).withColumn("ramp", shape))
    placed = sized.withColumn("md5", _stream_key(F.col("id")))
    joined = placed.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    order = F.conv(F.substring("md5", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 32) - 2)) / 2
    before = running(joined, "rank", order.cast("long"), F.col("size"), "before", sized.count(), ["md5", "id", "size"])
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("__words div source_size")).otherwise(0)
    rest = F.greatest(F.least(F.col("__words") - F.col("passes") * F.col("source_size") - F.col("before"), F.col("size")), F.lit(0))
    start = F.when((F.col("taken") > 0) & (F.col("target") > 0), position(F.col("before") / F.col("target"), F.col("ramp"), knots))
    return (
        before.withColumn("__words", words).withColumn("passes", whole).withColumn("taken", F.col("passes") * F.col("size") + rest).withColumn("first_position", start)
        .select("id", "source", "size", "source_size", "target", "taken", "passes", "first_position", "before", "ramp")
    )


def _shown(number: F.Column, knots: int) -> F.Column:
    """The time at which the curriculum shows a document in pass ``number`` of its source's stream, counted from 0."""
    part = (number * F.col("source_size") + F.col("before")) / F.col("target")
    return F.when(F.col("target") > 0, position(part, F.col("ramp"), knots)).otherwise(0.0)


def _passes(times: F.Column, words, knots: int) -> F.Column:
    """An array with the position and words of each of a document's passes; ``words`` gives those of pass k."""
    each = F.transform(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1), lambda k: F.struct(_shown(k, knots).alias("position"), words(k).alias("words")))
    return F.when(times > 0, each)


def schedule(mixed: DataFrame, knots: int = len(RAMPS[0])) -> DataFrame:
    """The rows of ``mixed``, one for each of its passes: with ``pass`` from 0, ``words``, ``position`` in the curriculum and ``place``.

    place numbers all passes of all documents from 0 in the order of their positions, ties by md5 of the id, id and size.
    A document of which nothing is taken has one row, all four of them null. Numbers are given part by part of a range
    sort by position, so no task holds the order.
    """
    rest = F.col("taken") - F.col("passes") * F.col("size")
    times = F.when(F.col("taken") > 0, F.col("passes") + F.when(rest > 0, 1).otherwise(0)).otherwise(0)
    shown = _passes(times, lambda k: F.when(k < F.col("passes"), F.col("size")).otherwise(rest), knots)
    rows = materialize(mixed.select("*", shown.alias("__shown")).select("*", F.posexplode_outer("__shown").alias("pass", "__one")).select(*mixed.columns, "pass", "__one.words", "__one.position"))
    order = ["position", "__md5", "id", "size", "pass"]
    taken = rows.where("pass is not null").withColumn("__md5", _stream_key(F.col("id")))
    placed = carried(dealt(taken, [F.col(c) for c in order]), (), F.count("*"), F.sum("__edge"), "__before")
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    numbered = placed.select(*rows.columns, (F.coalesce("__before", F.lit(0)) + inside - 1).cast("long").alias("place"))
    return numbered.unionByName(rows.where("pass is null").withColumn("place", F.lit(None).cast("long")))


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """Every pass of every taken document in training order: partition k is read before k + 1."""
    return schedule(mixed).where("pass is not null").repartitionByRange(partitions, "place").sortWithinPartitions("place")


def copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they are, in training order.

    Each pass of a document has a position of its own; the rows are range-partitioned and sorted by it, so partition k
    is read before k + 1. Documents stay whole, of any length: the one at the end of a source's stream is taken if at
    least half of it is. Null or empty texts, which cost nothing, are taken once. Rows that repeat an id, a null one too,
    are each taken as often as the one taken most, at its positions; ties in position go by id. An empty table gives no rows,
    and other columns may have any name.
    """
    knots = len(options.get("ramps", RAMPS)[0])
    rest = F.col("taken") - F.col("passes") * F.col("size")
    times = F.col("passes") + F.when(rest * 2 >= F.col("size"), 1).otherwise(0)
    often = F.greatest(times, F.when(F.col("size") == 0, 1).otherwise(0)).cast("int").alias("times")
    most = mix(docs, id_col, **options).groupBy("id").agg(F.max(F.struct(often, "before", "source_size", "target", "ramp")).alias("most")).select("id", "most.*")
    mine, at = fresh(docs.columns, "id", "position")
    shown = most.select("id", F.explode(_passes(F.col("times"), lambda k: k, knots)).alias("one")).select(F.col("id").alias(mine), F.col("one.position").alias(at))
    joined = docs.join(materialize(shown), docs[id_col].cast("long").eqNullSafe(F.col(mine)))
    return joined.repartitionByRange(at, mine).sortWithinPartitions(at, mine).drop(mine, at)


def _position_sql(part: str) -> str:
    """``position`` in SQL, over columns r0, r1, ... of a schedule's weights at its knots."""
    knots = len(RAMPS[0])
    step = 1.0 / (knots - 1)
    num = lambda x: f"{float(x)!r}::DOUBLE"
    piece = lambda i: f"((r{i} + r{i + 1}) / {num(2)} * {num(step)})"
    want, before, cases = f"(({part}) * ({' + '.join([num(0), *map(piece, range(knots - 1))])}))", num(0), []
    for i in range(knots - 1):
        rest = f"greatest({want} - ({before}), {num(0)})"
        x = f"{num(2)} * {rest} / (r{i} + sqrt(greatest(r{i} * r{i} + {num(2)} * ((r{i + 1} - r{i}) / {num(step)}) * {rest}, {num(0)})))"
        cases.append(f"WHEN {want} <= ({before}) + {piece(i)} THEN least({num(i * step)} + {x}, {num((i + 1) * step)})")
        before = f"{before} + {piece(i)}"
    return f"CASE {' '.join(cases)} ELSE {num(1)} END"


def _ramp_sql(knot: int) -> str:
    return "CASE " + " ".join(f"WHEN t.rank % {len(RAMPS)} = {i} THEN {float(r[knot])!r}::DOUBLE" for i, r in enumerate(RAMPS)) + " END"


#: The same law in SQL: shares and levels, each source's stream, and the place of every pass in the curriculum.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
wt AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
lev AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
lv AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM lev WHERE level <= cap / weight),
tg AS (SELECT wt.*, CASE WHEN lv.level IS NULL THEN cap ELSE least(cap, weight * lv.level) END AS target FROM wt, lv),
b AS (
  SELECT s.doc_id, s.h, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words, {", ".join(f"{_ramp_sql(k)} AS r{k}" for k in range(len(RAMPS[0])))},
         row_number() OVER () AS row,
         coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN tg t ON s.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS BIGINT) AS passes,
         CAST(CASE WHEN source_size > 0 THEN greatest(0, least(words - (words // source_size) * source_size - before, size)) ELSE 0 END AS BIGINT) AS rest FROM b),
p AS (SELECT *, unnest(generate_series(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END - 1)) AS pass FROM k WHERE passes * size + rest > 0),
o AS (SELECT row, pass, {_position_sql("(pass * source_size + before)::DOUBLE / target")} AS position, h, doc_id, size FROM p),
f AS (SELECT row, pass, position, row_number() OVER (ORDER BY position, h, doc_id, size, pass) - 1 AS place FROM o)
SELECT k.doc_id, k.size, k.source_size, k.target, k.passes * k.size + k.rest AS taken, f.position AS first_position, f.place AS first_place
FROM k LEFT JOIN f ON f.row = k.row AND f.pass = 0
"""
