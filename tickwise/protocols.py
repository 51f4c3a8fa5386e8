"""More registered queries: richer lattices, matching, timers, channels, traces, checks and provenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.catalogue import _EDGE, _DAILY, REACH, _events, _micros, _orders, _script, cents, edges, query, read, run
from tickwise.functions import scalar as S
from tickwise.operators import choice, lattices, linearize, matching
from tickwise.operators.closure import Closure
from tickwise.plans import provenance, traces
from tickwise.plans.rules import Atom, Const, Relation, Rule
from tickwise.plans.ticks import Table, Tick, Ticks
from tickwise.streaming import channels, timers

_REACH = f"{_EDGE}, reach AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)"
_TC = [Rule("reach", ("x", "y"), (Atom("edge", ("x", "y")),)), Rule("reach", ("x", "z"), (Atom("reach", ("x", "y")), Atom("edge", ("y", "z"))))]

# ---- lattices kept as rows


@query("SELECT s, q, max(n) AS n FROM (SELECT l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def lbag_max(spark, d):
    replicas = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag").agg(F.count("*").alias("n"))
    return lattices.bag_join(replicas.drop("l_returnflag"), "n")


@query("""SELECT user_id AS u, day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT *, epoch_us(ts) // 86400000000 AS day FROM events) e
WHERE day = (SELECT max(epoch_us(ts) // 86400000000) FROM events f WHERE f.user_id = e.user_id) GROUP BY 1, 2""")
def lex_register(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("u"), F.expr("at div 86400000000").alias("day"), F.col("event_type").alias("k"))
    return lattices.lex_join(rows, ("u",), "day", {"kinds": F.array_join(F.array_sort(F.collect_set("k")), ",")})


@query("""WITH v AS (SELECT c_nationkey AS n, c_custkey AS c, CAST(round(c_acctbal * 100) AS BIGINT) AS b FROM customer)
SELECT n, c, b FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.n = v.n AND w.b >= v.b AND w.c >= v.c AND (w.b > v.b OR w.c > v.c))""")
def ldom_undominated(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("c"), cents("c_acctbal").alias("b"))
    return lattices.undominated(rows, ("n",), "b", "c")


@query(f"{_REACH} SELECT x AS element, least(x, min(y)) AS class FROM reach GROUP BY x")
def union_find(spark, d):
    return lattices.classes(edges(spark, d), "x", "y")


@query("SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def tombset_live(spark, d):
    ev = read(spark, d, "events").withColumnRenamed("user_id", "u")
    return lattices.live(ev.where("event_type = 'signup'").select("u"), ev.where("event_type = 'error' and value > 90").select("u"))


@query("""SELECT DISTINCT user_id AS u, event_type AS k FROM events a WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = a.user_id AND r.ts >= a.ts)""")
def causal_observed_remove(spark, d):
    ev = _events(spark, d)
    adds = ev.select(F.col("user_id").alias("u"), F.col("event_type").alias("k"), F.col("event_id").alias("dot"), "at")
    seen_by = ev.where("event_type = 'error'").groupBy(F.col("user_id").alias("u")).agg(F.max("at").alias("upto"))
    removes = adds.join(seen_by, "u").where("at <= upto").select("dot")
    return lattices.observed_remove(adds.drop("at"), removes, ("dot",))


@query("SELECT l_partkey AS p, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN min(l_suppkey) END AS s, min(l_suppkey) <> max(l_suppkey) AS is_top FROM lineitem GROUP BY 1")
def lconflict(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return lattices.conflicts(rows, ("p",), "s")


@query("SELECT o_custkey % 10 AS g, i AS place, max(v) AS v FROM (SELECT o_custkey, unnest([0, 1, 2]) AS i, unnest([o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT)]) AS v FROM orders) GROUP BY 1, 2")
def lvec_join(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 10).alias("g"), F.array("o_orderkey", "o_custkey", F.round("o_totalprice").cast("bigint")).alias("v"))
    return lattices.vector_join(rows, ("g",), "v")


# ---- choice under several dependencies, precedence, aggregates of one's own

_CAND = "SELECT s_nationkey AS n, p_brand AS b, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"


@query(f"""WITH RECURSIVE c AS (SELECT n, b, row_number() OVER (ORDER BY lines DESC, n, b, lines) AS i, lines FROM ({_CAND})),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS ns, CAST([] AS VARCHAR[]) AS bs, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS BIGINT) AS lines
 UNION ALL SELECT c.i, CASE WHEN ok THEN list_append(ns, c.n) ELSE ns END, CASE WHEN ok THEN list_append(bs, c.b) ELSE bs END, CASE WHEN ok THEN c.n END, CASE WHEN ok THEN c.b END, CASE WHEN ok THEN c.lines END
 FROM (SELECT r.ns, r.bs, c.*, NOT list_contains(r.ns, c.n) AND NOT list_contains(r.bs, c.b) AS ok FROM r JOIN c ON c.i = r.i + 1) c)
SELECT n, b, lines FROM r WHERE n IS NOT NULL""")
def choose_matching(spark, d):
    """Each nation takes one brand and each brand one nation, the pairs with most lines first."""
    nations, brands = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n")), read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("b"))
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return matching.choose_all(lines.groupBy("n", "b").agg(F.count("*").alias("lines")), [("n",), ("b",)], [F.col("lines").desc()])


@query("SELECT c, o FROM (SELECT o_custkey AS c, o_orderkey AS o, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders WHERE o_orderpriority < '3')  WHERE r = 1")
def resolve_prefer(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), "o_orderpriority")
    return choice.prefer([orders.where(F.col("o_orderpriority").startswith(k)).select("c", "o") for k in ("1", "2")], ("c",))


@query()
def choose_rand(spark, d):
    return choice.choose_fresh(_orders(spark, d), ("c",), node="a", incarnation=1, tick=5, seed=7)


@query("SELECT user_id AS u, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS BIGINT) AS spread FROM (SELECT user_id, CAST(round(value * 10) AS BIGINT) AS v FROM events) GROUP BY 1")
def user_aggregate(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("u"), "event_id", F.round(F.col("value") * 10).cast("bigint").alias("v"))
    state = lambda n, s, q: F.struct(n.cast("bigint").alias("n"), s.cast("bigint").alias("s"), q.cast("bigint").alias("q"))
    step = lambda a, x: state(a["n"] + 1, a["s"] + x["v"], a["q"] + x["v"] * x["v"])
    join = lambda a, b: state(a["n"] + b["n"], a["s"] + b["s"], a["q"] + b["q"])
    return choice.user_aggregate(rows, ("u",), state(F.lit(0), F.lit(0), F.lit(0)), step, join, lambda a: a["n"] * a["q"] - a["s"] * a["s"], "spread")


@query("SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY 1")
def approx_distinct(spark, d):
    """A sketch's estimate, next to the count that it stands for."""
    # a sketch takes no note of repetition, so it is fed the distinct pairs; beside a count of distinct values Spark would keep one a pair
    pairs = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), "l_partkey").distinct()
    by_flag = pairs.groupBy("f").agg(F.approx_count_distinct("l_partkey", 0.01).alias("n"), F.count("l_partkey").alias("exact"))
    return by_flag.select("f", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near"))


@query("""WITH s AS (SELECT event_type AS k, CAST(event_id % 97 AS DOUBLE) AS v FROM (SELECT event_id, event_type FROM events) WHERE CAST('0x' || substr(md5(event_id || '|' || event_type), 1, 8) AS BIGINT) < 1073741824)
SELECT k, count(*) AS sampled, count(*) * 4 AS count, sum(v) * 4 AS sum, round(avg(v), 6) AS avg, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS avg_error FROM s GROUP BY 1""")
def online_estimate(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("k"))
    return choice.estimate(rows, ("k",), F.col("event_id") % 97, one_in=4).withColumns({"avg": F.round("avg", 6), "avg_error": F.round("avg_error", 6)})


@query(f"{_REACH}, left_ AS (SELECT x, y FROM edge WHERE x <> (SELECT min(x) FROM edge)), r2 AS (SELECT x, y FROM left_ UNION SELECT r.x, e.y FROM r2 r JOIN left_ e ON r.y = e.x) SELECT * FROM reach EXCEPT SELECT * FROM r2")
def tc_retracted(spark, d):
    """Rows lost when a supplier's edges go: the recursion is evaluated anew and compared, class by class."""
    edge = edges(spark, d)
    kept = edge.join(edge.agg(F.min("x").alias("gone")), F.col("x") == F.col("gone"), "left_anti")
    return Closure(edge).lost(Closure(kept))


# ---- timers, channels and faults


@query("""WITH c AS (SELECT user_id AS u, min(epoch_us(ts)) AS boot, max(epoch_us(ts)) AS now FROM events GROUP BY 1)
SELECT u, k AS count, boot + (k + 1) * 172800000000 AS at FROM (SELECT *, unnest(generate_series(0, 4)) AS k FROM c) WHERE boot + (k + 1) * 172800000000 <= now""")
def timer_firings(spark, d):
    clocks = read(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.min(_micros("ts")).alias("boot"), F.max(_micros("ts")).alias("now")).withColumn("last", F.col("boot"))
    return timers.fired(clocks, 172_800_000_000, times=5)


@query("SELECT event_id AS dot, user_id AS u FROM events WHERE event_id % 10 <> 3")
def exactly_once(spark, d):
    sent = read(spark, d, "events").select(F.col("event_id").alias("dot"), F.col("user_id").alias("u"))
    return channels.once(sent.unionByName(sent.where("dot % 2 = 0")), ("dot",), sent.where("dot % 10 = 3"))


_GOT = "SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_quantity <= 40"


@query(f"SELECT o, max(n) AS upto FROM (SELECT o, n, row_number() OVER (PARTITION BY o ORDER BY n) AS k FROM ({_GOT})) WHERE n = k GROUP BY 1")
def cumulative_prefix(spark, d):
    got = read(spark, d, "lineitem").where("l_quantity <= 40").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n"))
    return channels.prefix(got, ("o",), "n", start=1)


@query("SELECT p, min(k) AS lo, max(k) AS hi FROM (SELECT o_orderpriority AS p, o_orderkey AS k, o_orderkey - row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS g FROM orders) GROUP BY p, g")
def range_islands(spark, d):
    return channels.islands(read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k")), ("p",), "k", bucket=256)


_SEAL = "SELECT user_id AS u, min(ts) AS sealed_at FROM events WHERE event_type = 'error' GROUP BY 1"


@query(f"SELECT event_id AS e, user_id AS u FROM events JOIN ({_SEAL}) ON u = user_id WHERE event_type = 'purchase' AND ts > sealed_at")
def seal_late(spark, d):
    ev = read(spark, d, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), "ts", "event_type")
    seals = ev.where("event_type = 'error'").groupBy("u").agg(F.min("ts").alias("sealed_at"))
    return channels.late(ev.where("event_type = 'purchase'"), seals, ("u",), "ts", "sealed_at").select("e", "u")


@query("SELECT o_orderkey AS o, o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber)) AS final FROM orders")
def final_output(spark, d):
    from tickwise.catalogue import QUERIES

    return channels.with_finality(read(spark, d, "orders").select(F.col("o_orderkey").alias("o")), QUERIES["seal_complete"](spark, d), ("o",))


_MSG = "SELECT event_id AS e, user_id % 5 AS src, event_id % 5 AS dst, epoch_us(ts) // 86400000000 - 19723 AS tick FROM events"


@query(f"SELECT e, src, dst, tick + 1 AS tick FROM ({_MSG}) WHERE (src = dst OR (src + 2 * dst + tick) % 7 <> 0) AND NOT (src = 3 AND tick >= 20) AND NOT (dst = 3 AND tick + 1 >= 20)")
def faulty_delivery(spark, d):
    sent = _events(spark, d).select(F.col("event_id").alias("e"), (F.col("user_id") % 5).alias("src"), (F.col("event_id") % 5).alias("dst"), F.expr("at div 86400000000 - 19723").alias("tick"))
    lost = sent.select("src", "dst", "tick").distinct().where("(src + 2 * dst + tick) % 7 = 0")
    return channels.deliver(sent, lost, spark.sql("select 3L as node, 20L as tick"))


@query(f"SELECT e, src, dst, tick FROM ({_MSG}) WHERE NOT ((src = dst OR (src + 2 * dst + tick) % 7 <> 0) AND NOT (src = 3 AND tick >= 20) AND NOT (dst = 3 AND tick + 1 >= 20))")
def undelivered(spark, d):
    """Messages that were sent and are not among those received."""
    from tickwise.catalogue import QUERIES

    sent = _events(spark, d).select(F.col("event_id").alias("e"), (F.col("user_id") % 5).alias("src"), (F.col("event_id") % 5).alias("dst"), F.expr("at div 86400000000 - 19723").alias("tick"))
    return channels.undelivered(sent, QUERIES["faulty_delivery"](spark, d), ("e",))


@query("""SELECT point, count(*) AS n, min(ts) AS first FROM events JOIN (SELECT CAST(m // 4 * k AS BIGINT) AS point FROM (SELECT max(event_id) AS m FROM events), (SELECT unnest([1, 2, 3, 4]) AS k)) ON event_id <= point GROUP BY 1""")
def progressive_snapshots(spark, d):
    """Counts at each quarter of the log."""
    log = read(spark, d, "events").select("event_id", "ts")
    quarter = (log.agg(F.max("event_id")).first()[0] or 0) // 4
    return channels.snapshot_totals(log, "event_id", [quarter * k for k in (1, 2, 3, 4)], {"n": F.count("*"), "first": F.min("ts")}, {"n": F.sum("n"), "first": F.min("first")})


@query(f"SELECT user_id AS u, event_type AS k, min(tick) AS tick FROM {_DAILY} GROUP BY 1, 2")
def tick_dedup(spark, d):
    """Each user's first event of a kind: what was seen before is filtered, and what is new is remembered."""

    def step(t: Tick) -> None:
        now = t.events["ev"].select(F.col("user_id").alias("u"), F.col("event_type").alias("k")).distinct()
        t.insert("seen", now.join(t.tables["seen"], ["u", "k"], "left_anti").withColumn("tick", F.lit(t.number).cast("bigint")))

    return Ticks(spark, [Table("seen", "u long, k string, tick long", ("u", "k"))], step).run(_script(spark, d))["seen"]


# ---- traces and checks

_TRACE = "SELECT DISTINCT user_id AS node, epoch_us(ts) // 86400000000 AS tick, event_type AS k FROM events"


def _trace(spark, d) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").alias("node"), F.expr("at div 86400000000").alias("tick"), F.col("event_type").alias("k")).distinct()


@query(f"SELECT node, k, min(tick) AS from_tick, max(tick) AS to_tick FROM (SELECT *, tick - row_number() OVER (PARTITION BY node, k ORDER BY tick) AS g FROM ({_TRACE})) GROUP BY node, k, g")
def trace_spans(spark, d):
    return traces.spans(_trace(spark, d))


@query(f"SELECT DISTINCT node, k FROM ({_TRACE}) WHERE tick <= 19730")
def trace_ever(spark, d):
    return traces.ever(_trace(spark, d), upto=19730)


@query(f"SELECT node, k FROM ({_TRACE}) WHERE tick BETWEEN 19724 AND 19725 GROUP BY 1, 2 HAVING count(*) = 2")
def trace_always(spark, d):
    return traces.always(_trace(spark, d), 19724, 19725)


@query(f"SELECT tick FROM (SELECT DISTINCT node, tick FROM ({_TRACE})) GROUP BY 1 HAVING count(*) * 2 > (SELECT count(DISTINCT user_id) FROM events)")
def trace_quorum(spark, d):
    return traces.quorum(_trace(spark, d), read(spark, d, "events").select(F.col("user_id").alias("node")), ("tick",))


@query(f"SELECT node, k FROM ({_TRACE}) WHERE tick = 19730")
def trace_at(spark, d):
    return traces.at(_trace(spark, d), 19730)


@query(f"SELECT k, min(node) AS least, max(node) AS most FROM ({_TRACE}) GROUP BY 1 HAVING min(node) <> max(node)")
def trace_agree(spark, d):
    """Where nodes do not agree: kinds that two of them had."""
    return traces.agree(_trace(spark, d), ("k",), "node")


@query(f"SELECT a.src AS sender, a.dst AS receiver, a.e, a.tick AS sent_at, a.tick + 1 AS got_at FROM ({_MSG}) a WHERE (src = dst OR (src + 2 * dst + tick) % 7 <> 0) AND NOT (src = 3 AND tick >= 20) AND NOT (dst = 3 AND tick + 1 >= 20)")
def trace_caused(spark, d):
    """Messages as edges of what happened before what."""
    from tickwise.catalogue import QUERIES

    sent = _events(spark, d).select(F.col("event_id").alias("e"), (F.col("user_id") % 5).alias("node"), (F.col("event_id") % 5).alias("dst"), F.expr("at div 86400000000 - 19723").alias("tick"))
    got = QUERIES["faulty_delivery"](spark, d).select(F.col("dst").alias("node"), "tick", "e")
    return traces.caused(sent, got, ("e",))


_HIST = """WITH w AS (SELECT o_custkey % 40 AS key, 'w' AS kind, o_orderkey AS v, o_orderkey * 3 AS b, o_orderkey * 3 + 40 + o_custkey % 30 AS e FROM orders),
r AS (SELECT key, 'r' AS kind, CASE WHEN v % 50 = 7 THEN -v ELSE v END AS v, b + CASE WHEN v % 37 = 0 THEN -400 ELSE v % 29 END AS b, b + CASE WHEN v % 37 = 0 THEN -200 ELSE v % 29 + 25 END AS e FROM w WHERE v % 3 = 0),
h AS (SELECT * FROM w UNION ALL SELECT * FROM r),
i AS (SELECT * FROM h UNION ALL SELECT key, 'w', NULL, min(b) - 2, min(b) - 1 FROM h GROUP BY key),
z AS (SELECT key, v, min(e) AS f, max(b) AS s, count(*) FILTER (kind = 'w') AS n, min(b) FILTER (kind = 'w') AS born, min(e) FILTER (kind = 'r') AS seen FROM i GROUP BY key, v)"""


@query(f"""{_HIST} SELECT key, v, CASE WHEN n = 0 THEN 'never written' WHEN n > 1 THEN 'written twice' ELSE 'read before its write' END AS problem FROM z WHERE n <> 1 OR seen < born
UNION ALL SELECT key, v, 'inside another zone' FROM z WHERE f >= s AND EXISTS (SELECT 1 FROM z a WHERE a.key = z.key AND a.f < a.s AND a.f < z.s AND z.f < a.s)
UNION ALL SELECT key, v, 'zones overlap' FROM z WHERE f < s AND EXISTS (SELECT 1 FROM z a WHERE a.key = z.key AND a.f < a.s AND z.f < a.s
 AND (a.f < z.f OR (a.f = z.f AND a.s < z.s)))""")
def linearizable(spark, d):
    """A history made of the orders: writes, and reads of some of them, a few of them impossible."""
    w = read(spark, d, "orders").selectExpr("o_custkey % 40 as key", "'w' as kind", "o_orderkey as v", "o_orderkey * 3 as b", "o_orderkey * 3 + 40 + o_custkey % 30 as e")
    r = w.where("v % 3 = 0").selectExpr("key", "'r' as kind", "if(v % 50 = 7, -v, v) as v", "b + if(v % 37 = 0, -400, v % 29) as b", "b + if(v % 37 = 0, -200, v % 29 + 25) as e")
    return linearize.violations(w.unionByName(r), ("key",), "kind", "v", "b", "e")


@query(f"""{_REACH}, e2 AS (SELECT x, y FROM edge) SELECT 'reach' AS head, '["' || x || '","' || y || '"]' AS "row", 0 AS rule, 'edge' AS premise, '["' || x || '","' || y || '"]' AS premise_row FROM e2
UNION ALL SELECT DISTINCT 'reach', '["' || r.x || '","' || e.y || '"]', 1, 'reach', '["' || r.x || '","' || r.y || '"]' FROM reach r JOIN edge e ON r.y = e.x
UNION ALL SELECT DISTINCT 'reach', '["' || r.x || '","' || e.y || '"]', 1, 'edge', '["' || e.x || '","' || e.y || '"]' FROM reach r JOIN edge e ON r.y = e.x""")
def provenance_steps(spark, d):
    return provenance.derivations(_TC, [REACH], {"edge": edges(spark, d)})


@query("""SELECT c_custkey AS c, CASE WHEN c_mktsegment <> 'BUILDING' THEN 0 WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 1
WHEN NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND l_returnflag = 'R') THEN 2 ELSE 3 END AS met FROM customer""")
def provenance_why_not(spark, d):
    env = {
        "customer": read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "orders": read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
        "lineitem": read(spark, d, "lineitem").select("l_orderkey", "l_returnflag"),
    }
    rule = Rule("q", ("c",), (Atom("customer", ("c", Const("BUILDING"))), Atom("orders", ("o", "c", Const("1-URGENT"))), Atom("lineitem", ("o", Const("R")))))
    return provenance.why_not(rule, Relation("q", ("c",)), env, env["customer"].select(F.col("c_custkey").alias("c")))


# ---- bytes and maps

_ZIG = "CAST(CASE WHEN b >= 0 THEN 2 * b ELSE -2 * b - 1 END AS BIGINT)"


@query(f"""WITH v AS (SELECT c_custkey AS c, CAST(round(c_acctbal * 100) AS BIGINT) AS b FROM customer), z AS (SELECT c, b, {_ZIG} AS u FROM v)
SELECT c, CASE WHEN u < 128 THEN printf('%02X', u) WHEN u < 16384 THEN printf('%02X%02X', u % 128 + 128, u // 128) ELSE printf('%02X%02X%02X', u % 128 + 128, u // 128 % 128 + 128, u // 16384) END AS digits,
b AS back, CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 ELSE 3 END AS after FROM z""")
def scalar_varint(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("c"), S.varint(cents("c_acctbal")).alias("x"))
    return rows.select("c", F.hex("x").alias("digits"), S.varint_at(F.col("x"), F.lit(0)).alias("got")).select("c", "digits", F.col("got.value").alias("back"), F.col("got.next").alias("after"))


@query("SELECT c_custkey AS c, printf('%04X', c_custkey % 65536) AS two, c_custkey % 65536 AS back, CASE WHEN c_custkey % 65536 >= 32768 THEN c_custkey % 65536 - 65536 ELSE c_custkey % 65536 END AS signed, CAST(NULL AS BIGINT) AS past FROM customer")
def scalar_bytes(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("c"), S.int_bytes(F.col("c_custkey") % 65536, 2).alias("x"))
    return rows.select("c", F.hex("x").alias("two"), S.int_at(F.col("x"), F.lit(0), 2).alias("back"), S.int_at(F.col("x"), F.lit(0), 2, signed=True).alias("signed"), S.int_at(F.col("x"), F.lit(1), 2).alias("past"))


@query("SELECT user_id AS u, string_agg(k || ':' || n, ',' ORDER BY k) AS kept, bool_or(k = 'click') AS clicks, CAST(coalesce(max(n) FILTER (k = 'view'), -1) AS BIGINT) AS views FROM (SELECT user_id, event_type AS k, max(event_id) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1")
def scalar_maps(spark, d):
    last = read(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.max("event_id").alias("n"))
    maps = last.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).withColumn("m", S.map_remove(F.col("m"), F.lit("error"))).where(F.size("m") > 0)
    shown = F.array_join(F.transform(S.map_entries(F.col("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return maps.select("u", shown.alias("kept"), F.map_contains_key("m", "click").alias("clicks"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(-1)).alias("views"))

