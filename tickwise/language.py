"""Registered queries for the rule language, table kinds, the scalar library and lattice operations, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.catalogue import _DAILY, _EDGE, _ORD, _events, _script, ask, cents, edges, query, read, run
from tickwise.functions import extern
from tickwise.functions import lattice as L
from tickwise.functions import scalar as S
from tickwise.operators import choice, joins
from tickwise.plans.lattice import Lattice
from tickwise.plans.rules import Agg, Any_, Atom, Const, Each, Expr, Fold, Guard, Let, Lookup, Not, Parts, Relation, Rule, Some, block, keys_of, member
from tickwise.plans.shared import materialize
from tickwise.plans.ticks import Table, Tick, Ticks
from tickwise.sources import config

# ---- rules


@query(f"{_EDGE}, reach AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x) SELECT * FROM reach")
def any_recursive(spark, d):
    """A recursion inside alternatives: an edge, or a way and an edge."""
    either = Any_(((Atom("edge", ("x", "z")),), (Atom("reach", ("x", "y")), Atom("edge", ("y", "z")))))
    return run([Rule("reach", ("x", "z"), (either,))], [Relation("reach", ("x", "y"))], {"edge": edges(spark, d)}, "reach")


_OPT = "SELECT p_partkey AS p, CASE WHEN p_size > 10 THEN p_size END AS z FROM part"


def _options(spark, d) -> dict[str, DataFrame]:
    """Sizes of parts and of orders' lines, some of them None."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("p"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("z"))
    return {"a": part.where("p % 2 = 0"), "b": part.where("p % 2 = 1 and (z is null or z % 3 = 0)").select("z").distinct()}


@query(f"WITH o AS ({_OPT}) SELECT a.p, a.z FROM o a WHERE a.p % 2 = 0 AND EXISTS (SELECT 1 FROM o b WHERE b.p % 2 = 1 AND (b.z IS NULL OR b.z % 3 = 0) AND b.z IS NOT DISTINCT FROM a.z)")
def option_join(spark, d):
    return ask("p z", ("p", "z"), (Atom("a", ("p", "z")), Atom("b", ("z",))), _options(spark, d))


@query(f"WITH o AS ({_OPT}) SELECT a.p, a.z FROM o a WHERE a.p % 2 = 0 AND NOT EXISTS (SELECT 1 FROM o b WHERE b.p % 2 = 1 AND (b.z IS NULL OR b.z % 3 = 0) AND b.z IS NOT DISTINCT FROM a.z)")
def option_not(spark, d):
    return ask("p z", ("p", "z"), (Atom("a", ("p", "z")), Not((Atom("b", ("z",)),))), _options(spark, d))


@query("SELECT DISTINCT o_orderkey AS o, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 4 + 1 WHERE o_orderpriority = '1-URGENT'")
def named_and_expression_terms(spark, d):
    base = {"orders": read(spark, d, "orders"), "lineitem": read(spark, d, "lineitem")}
    body = (Atom("orders", {"o_orderkey": "o", "o_orderpriority": Const("1-URGENT")}, rest=True), Atom("lineitem", {"l_orderkey": "o", "l_linenumber": Expr("cast($o % 4 + 1 as int)"), "l_suppkey": "s"}, rest=True))
    return ask("o s", ("o", "s"), body, base)


@query("""SELECT o_custkey AS c, o_orderkey AS o, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'""")
def pattern_terms(spark, d):
    """A struct column taken apart, by position and by variant; a string literal with a dollar sign stays one."""
    kind = F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    orders = read(spark, d, "orders").select("o_custkey", F.struct(kind.alias("variant"), F.struct(F.col("o_orderkey").alias("key"), F.concat(F.lit("$"), "o_orderpriority").alias("mark")).alias("of"), cents("o_totalprice").alias("amount")).alias("order"))
    body = (Atom("orders", ("c", Parts((Parts(("o", "m")), "amount"), tag=1))), Guard("$m = '$2-HIGH'"))
    return ask("c o amount", ("c", "o", "amount"), body, {"orders": orders})


@query("SELECT p_partkey AS p, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS n FROM part WHERE p_size > 10 AND regexp_extract(p_brand, '([0-9]+)', 1) <> ''")
def refutable_let(spark, d):
    base = {"part": read(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("z"))}
    return ask("p n", ("p", "n"), (Atom("part", ("p", "b", Some("z"))), Let("n", "try_cast(nullif(regexp_extract($b, '([0-9]+)', 1), '') as bigint)", some=True)), base)


@query("SELECT n_nationkey AS n, coalesce(max(CAST(round(s_acctbal * 100) AS BIGINT)), 0) AS most, coalesce(string_agg(DISTINCT CAST(s_suppkey % 5 AS VARCHAR), ',' ORDER BY CAST(s_suppkey % 5 AS VARCHAR)), '') AS kinds FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def lookup_and_fold(spark, d):
    """A lattice cell read by key, and a set folded over a correlated body."""
    base = {"nation": read(spark, d, "nation").select("n_nationkey"), "s": read(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_nationkey", cents("s_acctbal").alias("b"))}
    rules = [
        Rule("best", ("n", "b"), (Atom("s", (None, "n", "b")),)),
        Rule("q", ("n", "m", "array_join(k, ',')"), (Atom("nation", ("n",)), Lookup("m", "best", ("n",), "0L"), Fold("k", "set", "array(cast($k0 % 5 as string))", (Atom("s", ("k0", "n", None)),), "array()"))),
    ]
    return run(rules, [Relation("best", ("n", "b"), {"b": "max"}), Relation("q", ("n", "most", "kinds"))], base, "q")


@query("SELECT DISTINCT p_brand AS b, i AS place, w AS word FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part) WHERE w IN ('a', 'blue', 'part', 'red', 'green')")
def enumerate_and_member(spark, d):
    body = (Atom("part", ("n", "b")), Each("w", "split($n, ' ')", index="i"), member("w", "array('a', 'blue', 'part', 'red', 'green')"))
    return ask("b place word", ("b", "i", "w"), body, {"part": read(spark, d, "part").select("p_name", "p_brand")})


@query("""SELECT 'big' AS kind, c_nationkey AS n, count(*) AS rows FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'all', c_nationkey, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY 2""")
def shared_header(spark, d):
    """Two statements under one header, whose valuations are derived once."""
    statements = [Rule("q", ("'all'", "n", Agg("count")), ()), Rule("q", ("'big'", "n", Agg("count")), (Guard("$c % 2 = 0"),))]
    rules = block("header", ("c", "n"), (Atom("customer", ("c", "n", "b")), Guard("$b > 0")), statements)
    base = {"customer": read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")}
    return run(rules, [Relation("header", ("c", "n")), Relation("q", ("kind", "n", "rows"))], base, "q")


@query("SELECT DISTINCT o_custkey AS c, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS rank, o_orderkey % 100 BETWEEN 10 AND 19 AS inside FROM orders")
def keys_match_and_range(spark, d):
    """A relation's keys alone, a match as a value, and a test for a range."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    whole = Relation("orders", ("o_orderkey", "o_custkey", "o_orderpriority"))
    body = (Atom("orders", ("o", "c", "p")), keys_of(whole, ("o_orderkey",), ("o",)), Let("rank", "case $p when '1-URGENT' then 1 when '2-HIGH' then 2 else 9 end"))
    return ask("c rank inside", ("c", "rank", "o % 100 between 10 and 19"), body, {"orders": orders})


@query("SELECT DISTINCT c_custkey AS c, (c_custkey % 24 > 20 OR c_custkey % 24 <= 4) AS night FROM customer")
def ring_interval(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("c"), S.ring_between(F.col("c_custkey") % 24, F.lit(20), F.lit(4)).alias("night"))


@query("SELECT l_suppkey AS s, bit_or(CAST(1 AS BIGINT) << CAST(l_linenumber AS INTEGER)) AS seen FROM lineitem GROUP BY 1")
def user_lattice(spark, d):
    """A lattice of one's own as a rule's head: bits that were ever set."""
    bits = Lattice("bits", F.bit_or)
    base = {"li": read(spark, d, "lineitem").select("l_suppkey", "l_linenumber")}
    rules = [Rule("seen", ("s", "shiftleft(1L, n)"), (Atom("li", ("s", "n")),))]
    return run(rules, [Relation("seen", ("s", "seen"), {"seen": bits})], base, "seen")


@query("SELECT a.event_id AS e, b.event_id AS f FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR")
def interval_join(spark, d):
    """Messages of two kinds that meet within two hours of each other."""
    ev, two = _events(spark, d), 7_200_000_000
    clicks = ev.where("event_type = 'click'").select(F.col("event_id").alias("e"), "user_id", F.col("at").alias("lo"), (F.col("at") + two).alias("hi"))
    buys = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("f"), "user_id", F.col("at").alias("bought"))
    return joins.range_join(buys, "bought", clicks, "lo", "hi", two, ("user_id",)).select("e", "f")


@query("SELECT k, CAST(x AS BIGINT) AS d, count(*) AS n FROM (SELECT event_type AS k, unnest(list_distinct(list(event_id % 10))) AS x FROM events GROUP BY 1) GROUP BY 1, 2")
def lattice_generator(spark, d):
    """One row per element of a set that a lattice relation holds."""
    rules = [Rule("digits", ("k", "array(i % 10)"), (Atom("e", ("i", None, None, "k", None)),)), Rule("q", ("k", "x", Agg("count")), (Atom("digits", ("k", "s")), Each("x", "$s")))]
    return run(rules, [Relation("digits", ("k", "s"), {"s": "set"}), Relation("q", ("k", "d", "n"))], {"e": _events(spark, d)}, "q")


@query("SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 3) GROUP BY 1")
def deployment_rows(spark, d):
    """Relations that a configuration names: files, and rows given in it."""
    base = config.relations(spark, {
        "customer": {"path": f"{d}/customer.parquet", "columns": ["c_custkey", "c_nationkey"]}, "nation": {"path": f"{d}/nation.parquet", "columns": ["n_nationkey", "n_name", "n_regionkey"]},
        "served": {"rows": [[1], [3]], "ddl": "region int"},
    })
    return ask("nation customers", ("m", Agg("count", "c")), (Atom("customer", ("c", "n")), Atom("nation", ("n", "m", "r")), Atom("served", ("r",))), base)


@query("SELECT p_partkey AS p, length(p_name) * 31 + p_size AS mark FROM part WHERE (length(p_name) * 31 + p_size) % 2 = 0")
def extern_function(spark, d):
    """A function of one's own, on Arrow batches, in a rule."""
    extern.extern(spark, "mark_of", lambda name, size: name.str.len() * 31 + size, "long")
    return ask("p mark", ("p", "m"), (Atom("part", ("p", "n", "z")), Let("m", "mark_of($n, $z)"), Guard("$m % 2 = 0")), {"part": read(spark, d, "part").select("p_partkey", "p_name", "p_size")})


@query("SELECT p_partkey AS p, p_name AS a, p_name AS b, true AS none FROM part")
def compression(spark, d):
    data = F.encode("p_name", "UTF-8")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("p"), data.alias("x"), extern.gzip_(data).alias("g"), extern.zstd(data).alias("z"))
    return rows.select("p", extern.gunzip(F.col("g")).cast("string").alias("a"), extern.unzstd(F.col("z")).cast("string").alias("b"), extern.gunzip(F.col("x")).isNull().alias("none"))


@query("""WITH c AS (SELECT user_id AS u, epoch_us(ts) // 86400000000 AS t, event_type AS k FROM events WHERE event_type IN ('signup', 'error')),
o AS (SELECT u, t, max(CASE WHEN k = 'signup' THEN 1 ELSE 0 END) AS alive FROM c GROUP BY 1, 2), v AS (SELECT *, lead(t) OVER (PARTITION BY u ORDER BY t) AS nt FROM o),
m AS (SELECT u FROM v WHERE alive = 1 AND t <= 19738 AND (nt IS NULL OR nt > 19738)) SELECT c_custkey AS c FROM customer JOIN m ON u = c_custkey WHERE c_acctbal > 0""")
def rule_over_history(spark, d):
    """A rule asked of a stored history as of a tick."""
    from tickwise.catalogue import QUERIES

    base = {"member": QUERIES["asof_db"](spark, d), "customer": read(spark, d, "customer").select("c_custkey", "c_acctbal")}
    return ask("c", ("c",), (Atom("member", ("c", None)), Atom("customer", ("c", "b")), Guard("$b > 0")), base)


# ---- table kinds


@query(f"SELECT tick + 1 AS tick, count(*) FILTER (new) AS gained FROM (SELECT DISTINCT user_id, tick, tick = min(tick) OVER (PARTITION BY user_id) AS new FROM {_DAILY}) GROUP BY 1")
def change_subscription(spark, d):
    """How many users each tick adds to a table, as its watcher saw them."""
    ticks = Ticks(spark, [Table("seen", "u long")], lambda t: t.insert("seen", t.events["ev"].select(F.col("user_id").alias("u"))))
    gained: list[DataFrame] = []
    ticks.watch("seen", lambda n, more, _: gained.append(materialize(more.agg(F.lit(n).cast("bigint").alias("tick"), F.count("*").alias("gained")))))
    ticks.run(_script(spark, d))
    return reduce(DataFrame.unionByName, gained)


@query(f"SELECT user_id AS u, max(event_id) AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM {_DAILY} GROUP BY 1")
def lattice_table(spark, d):
    """A table whose columns merge per key from tick to tick."""

    def step(t: Tick) -> None:
        t.insert("seen", t.events["ev"].select(F.col("user_id").alias("u"), F.col("event_id").alias("last"), F.array("event_type").alias("kinds")))

    table = Table("seen", "u long, last long, kinds array<string>", lattice={"last": "max", "kinds": "set"})
    return Ticks(spark, [table], step).run(_script(spark, d))["seen"].withColumn("kinds", F.array_join("kinds", ","))


@query(f"SELECT max(v) AS most FROM {_DAILY}")
def cell_register(spark, d):
    def step(t: Tick) -> None:
        t.insert("most", t.events["ev"].select(F.col("v").alias("most")))

    ticks = Ticks(spark, [Table("most", "most long", lattice={"most": "max"})], step)
    ticks.run(_script(spark, d))
    return ticks.view().cell("most", "most", 0)


@query(f"SELECT event_type AS k, count(*) FILTER (tick % 2 = 0) - count(*) FILTER (tick % 2 = 1) AS weight FROM {_DAILY} GROUP BY 1 HAVING count(*) FILTER (tick % 2 = 0) <> count(*) FILTER (tick % 2 = 1)")
def zset_table(spark, d):
    """Weights that add up over the ticks; on odd days events take back."""

    def step(t: Tick) -> None:
        t.insert("kinds", t.events["ev"].groupBy(F.col("event_type").alias("k")).agg((F.count("*") * (1 if t.number % 2 == 0 else -1)).alias("weight")))

    return Ticks(spark, [Table("kinds", "k string, weight long", kind="zset")], step).run(_script(spark, d))["kinds"]


@query(f"SELECT DISTINCT user_id AS u FROM {_DAILY} WHERE tick > (SELECT max(tick) FROM {_DAILY}) - 3")
def soft_table(spark, d):
    """Users seen in the last three ticks."""

    def step(t: Tick) -> None:
        t.insert("heard", t.events["ev"].select(F.col("user_id").alias("u")))

    return Ticks(spark, [Table("heard", "u long", kind="soft", ttl=3)], step).run(_script(spark, d))["heard"]


@query(f"SELECT event_type AS k, (SELECT count(*) FROM {_DAILY} f WHERE f.event_type = e.event_type AND tick > 0) AS later FROM {_DAILY} e WHERE tick = 0 GROUP BY 1")
def sealed_table(spark, d):
    """Kinds that the first tick fixes, and how often they come later."""

    def step(t: Tick) -> None:
        if t.fresh:
            t.insert("kinds", t.events["ev"].select(F.col("event_type").alias("k")))
        t.insert("later", matched_kinds(t))

    def matched_kinds(t: Tick) -> DataFrame:
        return t.events["ev"].join(t.tables["kinds"], F.col("event_type") == F.col("k")).select("event_id", "k")

    tables = Ticks(spark, [Table("kinds", "k string", kind="sealed"), Table("later", "event_id long, k string")], step).run(_script(spark, d))
    return tables["kinds"].join(tables["later"], "k", "left").groupBy("k").agg(F.count("event_id").alias("later"))


@query(f"SELECT c, o, p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p DESC, o) AS n FROM ({_ORD})) WHERE n = 1")
def resolve_most(spark, d):
    """A table that keeps, of what it has and what is staged, the dearest order of each customer; a tick for each priority."""
    orders = read(spark, d, "orders").select("o_orderpriority", F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), cents("o_totalprice").alias("p"))
    most = lambda rows: choice.choose_best(rows.drop("staged"), ("c",), F.col("p"), most=True)
    ticks = Ticks(spark, [Table("best", "c long, o long, p long", ("c",), resolve=most)], lambda t: t.insert("best", t.events["orders"]))
    kinds = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    return ticks.run([{"orders": orders.where(F.col("o_orderpriority") == k).drop("o_orderpriority")} for k in kinds])["best"]


@query(f"SELECT (user_id + 1) % 5 AS dst, event_type AS k, count(*) AS n FROM {_DAILY} WHERE tick <= (SELECT max(tick) FROM {_DAILY}) - 1 GROUP BY 1, 2")
def aggregate_into_send(spark, d):
    """Counts that are sent on to a node, where a later tick adds them up."""

    def step(t: Tick) -> None:
        if "count" in t.events:
            t.insert("got", t.events["count"].select("dst", "k", F.col("n").alias("weight")))
        if "ev" in t.events:
            sent = ask("dst k n", ("(u + 1) % 5", "k", Agg("count")), (Atom("ev", ("i", "u", "k", None)),), {"ev": t.events["ev"]})
            t.send("count", sent, to="dst")

    return Ticks(spark, [Table("got", "dst long, k string, weight long", kind="zset")], step).run(_script(spark, d))["got"].withColumnRenamed("weight", "n")


# ---- scalars

_LINES = "SELECT l_orderkey AS o, list(n ORDER BY n) AS v FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem) GROUP BY 1"


def _vectors(spark, d) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    return lines.groupBy("o").agg(F.array_sort(F.collect_list("n")).alias("v"))


def _shown(v) -> F.Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


@query(f"""SELECT o, v[2] AS second, v[1] AS first, v[-1] AS last, array_to_string(list_append(v, 99), ',') AS pushed, array_to_string(list_concat(v, v), ',') AS twice, len(v) = 0 AS none,
array_to_string(list_reverse(v), ',') AS back, array_to_string(list_sort(list_concat(v, [3, 0])), ',') AS ordered, array_to_string(list_concat(v, [7]), ',') AS flat, len(list_filter(v, lambda x: x > 5)) > 0 AS some FROM ({_LINES})""")
def vec_basics(spark, d):
    v = F.col("v")
    more = F.array(F.lit(3), F.lit(0)).cast("array<bigint>")
    return _vectors(spark, d).select(
        "o", F.get(v, F.lit(1)).alias("second"), F.try_element_at(v, F.lit(1)).alias("first"), F.try_element_at(v, F.lit(-1)).alias("last"), _shown(F.array_append(v, F.lit(99).cast("bigint"))).alias("pushed"), _shown(F.concat(v, v)).alias("twice"),
        (F.size(v) == 0).alias("none"), _shown(F.reverse(v)).alias("back"), _shown(S.sort_options(F.concat(v, more))).alias("ordered"), _shown(F.flatten(F.array(v, F.array(F.lit(7).cast("bigint"))))).alias("flat"), F.exists(v, lambda x: x > 5).alias("some"),
    )


@query(f"""SELECT o, array_to_string(list_transform(v, lambda x, i: (i - 1) || ':' || x), ',') AS numbered, array_to_string(list_transform(list_filter(v, lambda x: x % 2 = 0), lambda x: x * 10), ',') AS evens,
array_to_string(list_transform(v, lambda x, i: list_sum(v[1:i])), ',') AS sums, array_to_string(list_filter(list_transform(v, lambda x, i: list_sum(v[1:i])), lambda x: x <= 8), ',') AS upto, array_to_string(list_sort(list_distinct(list_transform(v, lambda x: x % 3))), ',') AS kinds,
list_max(list_filter(v, lambda x: x % 3 = 1)) AS last_of_one FROM ({_LINES})""")
def vec_more(spark, d):
    v, zero = F.col("v"), F.lit(0).cast("bigint")
    pairs = F.transform(v, lambda x: F.struct((x % 3).alias("key"), x.alias("value")))
    return _vectors(spark, d).select(
        "o", F.array_join(F.transform(S.enumerate_(v), lambda e: F.concat_ws(":", e["at"].cast("string"), e["value"].cast("string"))), ",").alias("numbered"), _shown(S.filter_map(v, lambda x: F.when(x % 2 == 0, x * 10))).alias("evens"),
        _shown(S.scan(v, zero, lambda a, x: a + x, "bigint")).alias("sums"), _shown(S.scan_while(v, zero, lambda a, x: F.when(a + x <= 8, a + x), "bigint")).alias("upto"), _shown(S.to_set(F.transform(v, lambda x: x % 3))).alias("kinds"),
        F.try_element_at(S.to_map(pairs), F.lit(1).cast("bigint")).alias("last_of_one"),
    )


@query(f"""WITH s AS (SELECT o, list_sort(list_distinct(list_transform(v, lambda x: x % 4))) AS a, list_sort(list_distinct(list_transform(v, lambda x: x % 3 + 1))) AS b FROM ({_LINES}))
SELECT o, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS m, list_contains(a, 2) AS has,
array_to_string(list_sort(list_distinct(list_append(a, 9))), ',') AS added, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS less, len(a) AS n FROM s""")
def set_ops(spark, d):
    a, b, num = S.to_set(F.transform("v", lambda x: x % 4)), S.to_set(F.transform("v", lambda x: x % 3 + 1)), lambda k: F.array(F.lit(k).cast("bigint"))
    return _vectors(spark, d).select(
        "o", _shown(S.union(a, b)).alias("u"), _shown(S.intersection(a, b)).alias("i"), _shown(S.difference(a, b)).alias("m"), F.array_contains(a, F.lit(2).cast("bigint")).alias("has"), _shown(S.union(a, num(9))).alias("added"),
        _shown(S.difference(a, num(1))).alias("less"), F.size(a).cast("bigint").alias("n"),
    )


@query("""WITH m AS (SELECT user_id AS u, event_type AS k, max(event_id) AS n FROM events GROUP BY 1, 2)
SELECT u, string_agg(k, ',' ORDER BY k) AS keys, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS vals, string_agg(k || '=' || CASE k WHEN 'view' THEN 0 ELSE n END, ',' ORDER BY k) FILTER (k <> 'view') || '' AS rest, bool_or(k = 'error') AS has, max(n) FILTER (k = 'click') AS got FROM m GROUP BY 1 HAVING count(*) FILTER (k <> 'view') > 0""")
def map_ops(spark, d):
    last = read(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.max("event_id").alias("n"))
    m = F.col("m")
    rest = S.map_remove(S.map_insert(m, F.lit("view"), F.lit(0).cast("bigint")), F.lit("view"))
    shown = F.array_join(F.transform(S.map_entries(rest), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    maps = last.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).where(F.size(rest) > 0)
    return maps.select("u", F.array_join(S.map_keys(m), ",").alias("keys"), _shown(S.map_values(m)).alias("vals"), shown.alias("rest"), F.map_contains_key(m, F.lit("error")).alias("has"), F.try_element_at(m, F.lit("click")).alias("got"))


@query(f"WITH o AS ({_OPT}) SELECT p, z IS NOT NULL AS is_some, z IS NULL AS is_none, coalesce(z, 7) AS or_seven, z * 2 AS doubled, CASE WHEN z > 25 THEN z - 25 END AS then_ FROM o")
def option_more(spark, d):
    z = F.col("z")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("p"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("z"))
    return rows.select("p", z.isNotNull().alias("is_some"), z.isNull().alias("is_none"), F.coalesce(z, F.lit(7)).alias("or_seven"), (z * 2).alias("doubled"), F.when(z.isNotNull(), F.when(z > 25, z - 25)).alias("then_"))


@query("""SELECT p_partkey AS p, hex(encode(p_brand)) AS utf8, hex(encode(substr(p_brand, 2, 3))) AS part, CASE WHEN length(p_brand) >= 60 THEN 'x' END AS past, hex(encode(p_brand || p_type)) AS both, hex(encode('<' || p_brand || p_brand || '>')) AS joined, '' AS empty,
hex(encode('Z' || substr(p_brand, 2))) AS put, p_brand AS back, CAST(p_partkey AS BIGINT) AS number, length(p_brand) + CASE WHEN p_partkey < 128 THEN 1 WHEN p_partkey < 16384 THEN 2 ELSE 3 END AS after, sha256(p_brand) || ':' || length(p_brand) AS address FROM part""")
def bytes_ops(spark, d):
    b = F.encode("p_brand", "UTF-8")
    n = S.uvarint_at(F.concat(b, S.uvarint(F.col("p_partkey"))), F.length(b))
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("p"), F.hex(b).alias("utf8"), F.hex(S.bytes_slice(b, F.lit(1), F.lit(4))).alias("part"), F.hex(S.bytes_slice(b, F.lit(1), F.lit(60))).alias("past"), F.hex(F.concat(b, F.encode("p_type", "UTF-8"))).alias("both"),
        F.hex(S.bytes_join(F.array(F.lit(b"<"), b, b, F.lit(b">")))).alias("joined"), F.hex(F.lit(b"")).alias("empty"), F.hex(S.put_int(b, F.lit(0), F.lit(90), 1)).alias("put"), S.from_utf8(b).alias("back"), n["value"].alias("number"), n["next"].alias("after"),
        F.concat_ws(":", S.blob(b)["hash"], S.blob(b)["length"].cast("string")).alias("address"),
    )


@query("""SELECT p_partkey AS p, array_to_string(string_split(trim(p_name), ' '), '|') AS words, p_name AS trimmed, lower(p_type) AS low, ends_with(p_type, 'L') AS ends, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS parsed,
CAST(p_partkey AS VARCHAR) AS i, CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS b, p_name AS s, printf('%.3f', p_size / 8.0) AS fixed, replace(p_name, ' ', '++') AS replaced FROM part""")
def scalar_text(spark, d):
    p, name = F.col("p_partkey"), F.col("p_name")
    number = F.concat(F.when(p % 2 == 0, "").otherwise("-"), p.cast("string"))
    return read(spark, d, "part").select(
        p.alias("p"), F.array_join(S.words(F.concat(F.lit(" \u2003"), name, F.lit("\t\n"))), "|").alias("words"), S.trim(F.concat(F.lit(" \u2003"), name, F.lit("\t\n"))).alias("trimmed"), F.lower("p_type").alias("low"), F.endswith("p_type", F.lit("L")).alias("ends"),
        S.parse_u64(number).alias("parsed"), p.cast("string").alias("i"), (F.col("p_size") > 20).cast("string").alias("b"), name.cast("string").alias("s"), S.to_fixed(F.col("p_size") / 8.0, 3).alias("fixed"), F.replace(name, F.lit(" "), F.lit("++")).alias("replaced"),
    )


@query("""SELECT c_custkey AS c, sqrt(c_custkey) AS root, CAST(floor(c_acctbal) AS BIGINT) AS down, CAST(ceil(c_acctbal) AS BIGINT) AS up, abs(c_custkey - 75) AS apart, least(c_custkey, 80) AS lo, greatest(c_custkey, 80) AS hi, c_custkey * c_custkey * c_custkey AS cube,
9223372036854775807 - c_custkey AS near_top, -9223372036854775808 + c_custkey AS wrapped, 9223372036854775807 AS held, 64 - length(ltrim(bin(c_custkey), '0')) AS zeros, -c_custkey AS minus, CAST(c_custkey AS DOUBLE) / 4 AS quarter FROM customer""")
def scalar_numbers(spark, d):
    c, b, top = F.col("c_custkey"), F.col("c_acctbal"), F.lit((1 << 63) - 1)
    return read(spark, d, "customer").select(
        c.alias("c"), F.sqrt(c).alias("root"), F.floor(b).cast("bigint").alias("down"), F.ceil(b).cast("bigint").alias("up"), F.abs(c - 75).alias("apart"), F.least(c, F.lit(80)).alias("lo"), F.greatest(c, F.lit(80)).alias("hi"), S.pow_i64(c, 3).alias("cube"),
        (top - c).alias("near_top"), S.wrapping_add(top, c + 1).alias("wrapped"), S.saturating_add(top, c).alias("held"), S.leading_zeros(c).cast("bigint").alias("zeros"), (-c).alias("minus"), S.divide(c.cast("double"), F.lit(4.0)).alias("quarter"),
    )


@query("""SELECT c_custkey AS c, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey // 4 AS VARCHAR) ELSE CAST(c_custkey // 4 AS VARCHAR) || CASE c_custkey % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS quarter,
CASE c_custkey WHEN 0 THEN '0' ELSE CAST(c_custkey AS VARCHAR) || '0000000000' END AS large, '0.' || repeat('0', 10 - length(CAST(c_custkey * 2 + 1 AS VARCHAR))) || rtrim(CAST(c_custkey * 2 + 1 AS VARCHAR), '0') AS small FROM customer""")
def scalar_float_text(spark, d):
    c = F.col("c_custkey")
    odd = F.concat((c * 2 + 1).cast("string"), F.lit("e-10")).cast("double")
    return read(spark, d, "customer").select(c.alias("c"), S.to_text(c / 4.0).alias("quarter"), S.to_text(c * 1e10).alias("large"), S.to_text(odd).alias("small"))


@query("""SELECT event_id AS e, epoch_us(ts) * 1000 // 1000000 AS ms, epoch_us(ts) * 1000 + event_id * 1000000 AS later, (epoch_us(ts) * 1000 + event_id * 1000000 - epoch_us(ts) * 1000) // 1000000 AS passed FROM events""")
def scalar_time(spark, d):
    at = F.col("at") * 1000
    later = at + S.from_millis(F.col("event_id"))
    return _events(spark, d).select(F.col("event_id").alias("e"), S.as_millis(at).alias("ms"), later.alias("later"), S.as_millis(later - at).alias("passed"))


@query("SELECT c_custkey AS c, true AS in_range, true AS in_unit, true AS same, true AS fine FROM customer")
def scalar_draws(spark, d):
    """Draws stay inside their bounds and depend on their key alone."""
    c = F.col("c_custkey")
    x, f = S.random_range(F.lit(5), F.lit(9), F.lit(7), c), S.random_float(F.lit(7), c)
    return read(spark, d, "customer").select(c.alias("c"), x.between(5, 8).alias("in_range"), ((f >= 0) & (f < 1)).alias("in_unit"), (x == S.random_range(F.lit(5), F.lit(9), F.lit(7), c)).alias("same"), S.error("a negative key", c < 0).alias("fine"))


@query("SELECT s_suppkey AS s, list_contains(['1', '2', '3'], CAST(s_suppkey % 4 AS VARCHAR)) AND list_contains(['1', '2', '3'], CAST(s_suppkey % 3 AS VARCHAR)) AND s_suppkey % 4 <> s_suppkey % 3 AS agreed FROM supplier")
def scalar_majority(spark, d):
    s = F.col("s_suppkey")
    votes = F.array_distinct(F.array((s % 4).cast("string"), (s % 3).cast("string")))
    return read(spark, d, "supplier").select(s.alias("s"), S.majority(votes, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("agreed"))


# ---- lattice operations

_BEST = """SELECT c_custkey AS c, max(p) FILTER (pr = '1-URGENT') AS x, max(p) FILTER (pr = '5-LOW') AS y, coalesce(list_sort(list(DISTINCT o % 5) FILTER (pr = '1-URGENT')), []) AS a, coalesce(list_sort(list(DISTINCT o % 5) FILTER (pr = '5-LOW')), []) AS b
FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS o, CAST(round(o_totalprice) AS BIGINT) AS p, o_orderpriority AS pr FROM orders) ON o_custkey = c_custkey GROUP BY 1"""


def _best(spark, d) -> DataFrame:
    """Per customer two maxima and two sets, of urgent orders and of the least, many of them at the bottom."""
    orders = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("o"), F.round("o_totalprice").cast("bigint").alias("p"), F.col("o_orderpriority").alias("pr"))
    urgent, low = F.col("pr") == "1-URGENT", F.col("pr") == "5-LOW"
    got = read(spark, d, "customer").select(F.col("c_custkey").alias("c")).join(orders, F.col("c") == F.col("o_custkey"), "left").groupBy("c")
    return got.agg(F.max(F.when(urgent, F.col("p"))).alias("x"), F.max(F.when(low, F.col("p"))).alias("y"), F.array_sort(F.collect_set(F.when(urgent, F.col("o") % 5))).alias("a"), F.array_sort(F.collect_set(F.when(low, F.col("o") % 5))).alias("b"))


@query(f"""SELECT c, greatest(x, y) AS j, x AS shown, x IS NULL AS bot, coalesce(x >= 200000, false) AS at_least, coalesce(x > 200000, false) AS above, x + 5 AS added, x + y AS summed, x - 5 AS less, CASE WHEN x IS NOT NULL THEN least(x, 250000) END AS held,
x IS NULL OR coalesce(x <= y, false) AS leq, (x IS NULL OR coalesce(x <= y, false)) AND NOT (y IS NULL OR coalesce(y <= x, false)) AS lt FROM ({_BEST})""")
def lattice_max(spark, d):
    x, y, k = F.col("x"), F.col("y"), F.lit(200000)
    return _best(spark, d).select(
        "c", L.join("max", x, y).alias("j"), L.reveal("max", L.lift("max", x)).alias("shown"), L.is_bot("max", x).alias("bot"), L.at_least(x, k).alias("at_least"), L.above(x, k).alias("above"), L.add(x, F.lit(5)).alias("added"), L.add_lat(x, y).alias("summed"),
        L.sub(x, F.lit(5)).alias("less"), L.min_of(x, F.lit(250000)).alias("held"), L.leq("max", x, y).alias("leq"), L.less("max", x, y).alias("lt"),
    )


@query(f"SELECT c, least(x, y) AS j, coalesce(x <= 200000, false) AS at_most, coalesce(x < 200000, false) AS below, x IS NULL OR coalesce(x >= y, false) AS leq, coalesce(x, y, 0) AS non_bot, CASE WHEN x IS NULL THEN y ELSE x END AS point FROM ({_BEST})")
def lattice_min_and_point(spark, d):
    x, y, k = F.col("x"), F.col("y"), F.lit(200000)
    some = F.coalesce(x, y, F.lit(0).cast("bigint"))
    return _best(spark, d).select(
        "c", L.join("min", x, y).alias("j"), L.at_most(x, k).alias("at_most"), L.below(x, k).alias("below"), L.leq("min", x, y).alias("leq"), L.reveal_non_bot(some).alias("non_bot"),
        L.get(L.join("point", L.of("point", x), F.when(x.isNull(), y).otherwise(x))).alias("point"),
    )


@query(f"""SELECT c, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS j, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, list_contains(a, 3) AS has, len(a) AS n, len(a) > 0 AS some, len(a) = 0 AS none, list_min(a) AS lo, list_max(a) AS hi,
coalesce(list_sum(a), 0)::BIGINT AS total, len(list_filter(a, lambda v: NOT list_contains(b, v))) = 0 AS leq, array_to_string(list_sort(list_distinct(list_append(a, 7))), ',') AS lifted FROM ({_BEST})""")
def lattice_set(spark, d):
    a, b = F.col("a"), F.col("b")
    return _best(spark, d).select(
        "c", _shown(L.join("set", a, b)).alias("j"), _shown(L.intersect(a, b)).alias("both"), L.contains(a, F.lit(3).cast("bigint")).alias("has"), L.size(a).alias("n"), L.nonempty(a).alias("some"), L.is_empty(a).alias("none"), L.min_elem(a).alias("lo"),
        L.max_elem(a).alias("hi"), L.total(a).alias("total"), L.leq("set", a, b).alias("leq"), _shown(L.join("set", a, L.of("set", F.lit(7).cast("bigint")))).alias("lifted"),
    )


@query("""WITH m AS (SELECT user_id AS u, event_type AS k, max(event_id) FILTER (event_id % 2 = 0) AS p, max(event_id) FILTER (event_id % 2 = 1) AS q FROM events GROUP BY 1, 2)
SELECT u, string_agg(k || '=' || greatest(p, q), ',' ORDER BY k) AS j, max(p) FILTER (k = 'click') AS at, coalesce(bool_or(k = 'error' AND p IS NOT NULL), false) AS has, coalesce(string_agg(k, ',' ORDER BY k) FILTER (p IS NOT NULL), '') AS keys,
count(p) AS n, bool_and(p IS NULL OR coalesce(p <= q, false)) AS leq, coalesce(string_agg(k || '=[' || p || ']', ',' ORDER BY k) FILTER (p IS NOT NULL), '') AS lifted FROM m GROUP BY 1""")
def lattice_map(spark, d):
    ev = read(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("p"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("event_id"))).alias("q"))
    held = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("k", c)), lambda e: e[c].isNotNull()))
    a, b = F.col("a"), F.col("b")
    shown = lambda m, one: F.array_join(F.transform(S.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), one(e["value"]))), ",")
    return ev.groupBy("u").agg(held("p").alias("a"), held("q").alias("b")).select(
        "u", shown(L.join("map:max", a, b), lambda v: v.cast("string")).alias("j"), L.at(a, F.lit("click")).alias("at"), L.has_key(a, F.lit("error")).alias("has"), F.array_join(L.key_set(a), ",").alias("keys"), L.size(a).alias("n"), L.leq("map:max", a, b).alias("leq"),
        shown(L.lift_entries("set", a), lambda v: F.concat(F.lit("["), _shown(v), F.lit("]"))).alias("lifted"),
    )


@query("SELECT c_custkey AS c, a OR b AS o, a AND b AS n, NOT a AS i, NOT a OR b AS leq, a OR b AS j FROM (SELECT c_custkey, c_acctbal > 0 AS a, c_custkey % 2 = 0 AS b FROM customer)")
def lattice_bool(spark, d):
    a, b = F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0
    return read(spark, d, "customer").select(F.col("c_custkey").alias("c"), L.or_(a, b).alias("o"), L.and_(a, b).alias("n"), L.not_(a).alias("i"), L.leq("bool", a, b).alias("leq"), L.join("bool", a, b).alias("j"))



