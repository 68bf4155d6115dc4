"""Queries of the private engine over the TPC-H-like tables, and the same maths in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import noise, votes
from veilspark.functions.keyhash import Settings, key_hash, signed
from veilspark.operators.diff import utility_diff
from veilspark.operators.lists import aggregate_lists
from veilspark.operators.worlds import Agg, aggregate, counters
from veilspark.plans.policy import Registry
from veilspark.plans.session import PrivateSession
from veilspark.sources.io import read_table, register_tables
from veilspark.streaming.worlds import release, sink, windowed_units

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: No noise: the first world is released, which SQL can tell.
EXACT = Settings(mi=0)


def policy() -> Registry:
    r = Registry()
    r.unit("customer", ["c_custkey"], ["c_name", "c_acctbal"])
    r.link("orders", ["o_custkey"], "customer", ["c_custkey"])
    r.link("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])
    r.unit("events", ["user_id"], ["user_id"])
    return r


def two_units() -> Registry:
    r = policy()
    r.unit("supplier", ["s_suppkey"], ["s_name"])
    r.link("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"])
    return r


def _sql(text: str, registry: Callable[[], Registry] = policy, settings: Settings = EXACT, **more: str) -> Query:
    words = set(re.findall(r"\w+", text.lower()))
    links = {x.table for t in words & set(TABLES) for path in registry().paths(t).values() for x in path}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir, [t for t in TABLES if t in words | links])
        p = PrivateSession(spark, registry(), settings)
        for name, value in more.items():
            p.set(name, value)
        return p.sql(text)

    return run


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its customer key."""
    o = read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return read_table(spark, f"{sf_dir}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


_GROUPS = ("l_returnflag", "l_linestatus")


def _groups() -> dict[str, Column]:
    return {g: F.col(g) for g in _GROUPS}


def _counters(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = counters(_lines(spark, sf_dir), _groups(), key_hash(F.col("o_custkey")), [Agg("c", kind, F.col("l_quantity"))], EXACT)
        return c.select(*_GROUPS, F.size("c").cast("long").alias("n"), *[F.round(F.get("c", F.lit(i)), 2).alias(f"c{i}") for i in range(64)])

    return run


def _list_of(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = counters(_lines(spark, sf_dir), _groups(), key_hash(F.col("o_custkey")), [Agg("c", "sum", F.col("l_quantity"))], EXACT)
        out = aggregate_lists(c, {"l_returnflag": F.col("l_returnflag")}, {"w": (kind, F.col("c"))})
        return out.select("l_returnflag", *[F.round(F.get("w", F.lit(i)), 2).alias(f"c{i}") for i in range(64)])

    return run


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [Agg("n", "count"), Agg("q", "sum", F.col("l_quantity")), Agg("d", "avg", F.col("l_discount")), Agg("lo", "min", F.col("l_shipdate")), Agg("hi", "max", F.col("l_extendedprice"))]
    out = aggregate(_lines(spark, sf_dir), _groups(), key_hash(F.col("o_custkey")), aggs, EXACT)
    return out.select(*_GROUPS, "n", F.round("q", 2).alias("q"), F.round("d", 6).alias("d"), "lo", F.round("hi", 2).alias("hi"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(_lines(spark, sf_dir), _groups(), key_hash(F.col("o_custkey")), [Agg("q", "sum", F.col("l_quantity"))], EXACT, wide=True)
    return out.select(*_GROUPS, F.round("q", 2).alias("q"))


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [Agg("parts", "count", F.col("l_linenumber"), distinct=True), Agg("total", "sum", F.col("l_linenumber"), distinct=True)]
    return aggregate(_lines(spark, sf_dir), _groups(), key_hash(F.col("o_custkey")), aggs, EXACT).select(*_GROUPS, "parts", F.round("total", 2).alias("total"))


# scalar functions over worlds made of each customer's key hash
def _worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = key_hash(F.col("c_custkey"))
    # bound, so that a row's key is hashed once and not for each world
    w = votes._let(k, lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(F.call_function("getbit", h, j) == 1, F.pmod(F.col("c_custkey") * (j + 1), F.lit(97)).cast("double"))))
    # 64 worlds a row make much work of few bytes, by which Spark would make few tasks: the number is given
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = read_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey").repartition(tasks, "c_custkey")
    return keys.select("c_custkey", k.alias("k"), w.alias("w"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _worlds(spark, sf_dir)
    some = F.transform("w", lambda x: x > 30)
    return d.select(
        "c_custkey",
        votes.select(some).alias("mask"),
        votes.filter_mask(F.col("k"), EXACT).alias("by_mask"),
        votes.filter_mask(F.col("k"), EXACT, F.when(F.col("c_custkey") % 2 == 0, 2.0)).alias("by_corrected"),
        votes.filter_list(F.transform("w", lambda x: x.isNull() | (x > 5)), EXACT).alias("by_list"),
        votes.mask_and(F.col("k"), votes.select(some)).alias("both"),
        votes.mask_or(F.col("k"), votes.select(some)).alias("either"),
        votes.mask_not(F.col("k")).alias("neither"),
        F.size(votes.coalesce_worlds(F.when(F.col("c_custkey") % 3 == 0, F.col("w")))).cast("long").alias("filled"),
        F.round(noise.noised(F.col("w"), EXACT), 4).alias("released"),
    )


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _worlds(spark, sf_dir)
    v = F.pmod(F.col("c_custkey"), F.lit(97)).cast("double")
    return d.select("c_custkey", *[votes.filter_compare(n, v, F.col("w"), EXACT, 1.5).alias(n) for n in votes.COMPARISONS])


#: Noise of a fixed seed, which SQL can draw as well.
NOISED = Settings(seed=7)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.pmod(F.col("c_custkey") * i, F.lit(31)).cast("double"))
    n = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.pmod(F.col("c_custkey"), F.lit(5)))
    return read_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", F.round(noise.aggregate_samples(x, n, NOISED.mi, 3, NOISED), 4).alias("value"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, TABLES)
    text = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag"
    out = utility_diff(PrivateSession(spark, policy(), EXACT).sql(text), spark.sql(text), 1)
    return out.select("l_returnflag", "n", F.round("q", 4).alias("q"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, in windows of a day."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        at = tempfile.mkdtemp(prefix="veilspark-")
    out = f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    one_file = len(files := table.inputFiles()) == 1 and files[0].endswith("/events.parquet")
    source = spark.readStream.schema(table.schema)  # streams read folders
    rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else source.parquet(f"{sf_dir}/events.parquet")
    sums = windowed_units(rows, "ts", "1 day", "1 day", key_hash(F.col("user_id")), {"event_type": F.col("event_type")}, F.col("value"))
    q = sums.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(sink(f"{out}/sums")).start()
    q.awaitTermination()
    r = release(spark.read.parquet(f"{out}/sums"), ["event_type"], EXACT)
    return r.select("start", "event_type", "n", F.round("total", 2).alias("total"))


Q = EXACT.query_hash
_BIT = "(k >> j) & 1 = 1"


def _h(key: str) -> str:
    return f"xor(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 16))::UBIGINT, {Q}::UBIGINT)"


def _oracle(select: str, groups: dict[str, str], values: dict[str, tuple[str, str]], rows: str, key: str, before: str = "", after: str = "") -> str:
    """SQL of one private aggregate. values: by name (kind, expression); select: over groups and values' released forms."""
    g = ", ".join(f"{e} AS {n}" for n, e in groups.items()) or "1 AS one"
    names = ", ".join(groups) or "one"
    v = ", ".join(f"{e} AS v_{n}" for n, (_, e) in values.items())
    world = {"count": "count(v_{n})", "sum": "sum(v_{n})", "avg": "sum(v_{n})", "min": "min(v_{n})", "max": "max(v_{n})"}
    per = ", ".join(f"{world[k].format(n=n)} AS w_{n}" for n, (k, _) in values.items())
    whole = ", ".join(f"count(v_{n}) AS t_{n}" for n in values)
    first = []
    for n, (k, _) in values.items():
        got = f"arg_min(w_{n}, j) FILTER (WHERE w_{n} IS NOT NULL" + (f" AND w_{n} > 0)" if k == "count" else ")")
        first.append({"count": f"CAST(2 * {got} AS BIGINT)", "sum": f"2 * {got}", "avg": f"2 * {got} / any_value(t_{n})"}.get(k, got) + f" AS {n}")
    return f"""
WITH {before} b AS (SELECT {g}, {_h(key)} AS k, {v} FROM {rows}),
     w AS (SELECT {names}, j, {per} FROM b, (SELECT unnest(range(64)) AS j) WHERE k IS NOT NULL AND {_BIT} GROUP BY {names}, j),
     t AS (SELECT {names}, {whole} FROM b WHERE k IS NOT NULL GROUP BY {names}),
     r AS (SELECT {names}, {", ".join(first)} FROM w JOIN t USING ({names}) GROUP BY {names})
SELECT {select} FROM r {after}
"""


_LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_BY = {g: g for g in _GROUPS}
_REV = "l_extendedprice * (1 - l_discount)"

Q1 = f"SELECT l_returnflag, l_linestatus, round(sum_qty, 2) AS sum_qty, round(sum_base, 1) AS sum_base, round(sum_disc, 1) AS sum_disc, round(sum_charge, 1) AS sum_charge, round(avg_qty, 6) AS avg_qty, round(avg_price, 3) AS avg_price, round(avg_disc, 8) AS avg_disc, n FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum({_REV}) AS sum_disc, sum({_REV} * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp'1998-09-02' GROUP BY l_returnflag, l_linestatus)"
Q1_NOISED = "SELECT l_returnflag, l_linestatus, round(sum_qty, 0) AS sum_qty, round(sum_base, -2) AS sum_base, round(avg_disc, 6) AS avg_disc, n FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp'1998-09-02' GROUP BY l_returnflag, l_linestatus)"
Q5 = f"SELECT n_name, round(revenue, 1) AS revenue FROM (SELECT n_name, sum({_REV}) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name)"
Q6 = "SELECT round(revenue, 2) AS revenue FROM (SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= timestamp'1994-01-01' AND l_shipdate < timestamp'1997-01-01' AND l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24)"
Q7 = f"SELECT supp_nation, cust_nation, yr, round(revenue, 1) AS revenue FROM (SELECT supp_nation, cust_nation, yr, sum(volume) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS yr, {_REV} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < 5 AND n2.n_nationkey < 5) GROUP BY supp_nation, cust_nation, yr)"
Q8 = f"SELECT yr, round(share, 6) AS share FROM (SELECT year(o_orderdate) AS yr, sum(CASE WHEN s_nationkey < 5 THEN {_REV} ELSE 0 END) / sum({_REV}) AS share FROM part, supplier, lineitem, orders WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey GROUP BY year(o_orderdate))"
Q13 = "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY c_count"
Q14 = f"SELECT round(promo, 6) AS promo FROM (SELECT 100.0 * sum(CASE WHEN p_size > 25 THEN {_REV} ELSE 0 END) / sum({_REV}) AS promo FROM lineitem, part WHERE l_partkey = p_partkey)"
Q15 = f"SELECT l_suppkey, round(revenue, 1) AS revenue FROM (SELECT l_suppkey, sum({_REV}) AS revenue FROM lineitem GROUP BY l_suppkey)"
Q17 = "SELECT round(total, 1) AS total FROM (SELECT sum(l_extendedprice) AS total FROM lineitem l, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.9 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey))"
Q19 = f"SELECT round(revenue, 1) AS revenue FROM (SELECT sum({_REV}) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 30 AND l_quantity BETWEEN 10 AND 20)))"
Q20 = "SELECT p_partkey FROM part WHERE p_size * 30 > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)"
Q22 = "SELECT c_mktsegment, n, round(bal, 2) AS bal FROM (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment)"
UNION = "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30"
UNION_BELOW = "SELECT count(*) AS n, round(sum(p), 1) AS p FROM (SELECT o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_totalprice AS p FROM orders WHERE o_totalprice > 300000)"
HAVING = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10"
TOP = "SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) ORDER BY n DESC, o_orderpriority LIMIT 3"
SEMI = "SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"
CLICKS = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"
Q4 = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= timestamp'1994-01-01' AND o_orderdate < timestamp'1997-01-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + interval 60 days) GROUP BY o_orderpriority"
_PROFIT = f"{_REV} - 0.1 * p_retailprice * l_quantity"
Q9 = f"SELECT n_name, yr, round(profit, 1) AS profit FROM (SELECT n_name, year(o_orderdate) AS yr, sum({_PROFIT}) AS profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_size > 25 GROUP BY n_name, year(o_orderdate))"
_HIGH = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"
Q12 = f"SELECT l_linestatus, sum({_HIGH}) AS high, sum(1 - {_HIGH}) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity < 20 GROUP BY l_linestatus"
_WAITS = "EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)"
Q21 = f"SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND {_WAITS} AND s_nationkey = n_nationkey AND n_nationkey < 10 GROUP BY s_name"
# shapes of a web-analytics benchmark over events, whose users are the unit
CLICK_COUNT = "SELECT count(*) AS n FROM events"
CLICK_STATS = "SELECT round(sum(value), 2) AS total, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value <> 0"
CLICK_USERS = "SELECT count(DISTINCT user_id) AS users FROM events"
CLICK_RANGE = "SELECT min(ts) AS lo, max(ts) AS hi FROM events"
CLICK_HOURS = "SELECT h, n FROM (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY hour(ts)) ORDER BY n DESC, h LIMIT 10"
CLICK_KINDS = "SELECT event_type, hour(ts) AS h, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type LIKE '%i%' GROUP BY event_type, hour(ts) HAVING count(*) > 4"
TWO = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"

_C5 = "customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_C7 = "supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < 5 AND n2.n_nationkey < 5"
_Q1_VALUES = {"sum_qty": ("sum", "l_quantity"), "sum_base": ("sum", "l_extendedprice"), "sum_disc": ("sum", _REV), "sum_charge": ("sum", f"{_REV} * (1 + l_tax)"), "avg_qty": ("avg", "l_quantity"), "avg_price": ("avg", "l_extendedprice"), "avg_disc": ("avg", "l_discount"), "n": ("count", "1")}


def _ratio(name: str, scale: str, groups: dict[str, str], above: str, below: str, rows: str, key: str) -> str:
    """A quotient of two sums, evaluated in every world; the first world that has one is released."""
    g = "".join(f"{e} AS {n}, " for n, e in groups.items())
    names = ", ".join(groups) or "one"
    return f"""
WITH b AS (SELECT {g or "1 AS one, "} {_h(key)} AS k, {above} AS x, {below} AS y FROM {rows}),
     w AS (SELECT {names}, j, {scale} * sum(x) / nullif(sum(y), 0) AS q FROM b, (SELECT unnest(range(64)) AS j) WHERE {_BIT} GROUP BY {names}, j)
SELECT {names + ", " if groups else ""} round(arg_min(q, j) FILTER (WHERE q IS NOT NULL), 6) AS {name} FROM w GROUP BY {names}
"""


def _vote_oracle(outer: str, inner_groups: str, inner_value: str, inner_rows: str, inner_key: str, avg: bool) -> str:
    """CTEs: lists of worlds of a correlated subquery, `vw(g, j, x)`."""
    div = "/ any_value(n)" if avg else ""
    return f"""
     ib AS (SELECT {inner_groups} AS g, {_h(inner_key)} AS k, {inner_value} AS v FROM {inner_rows}),
     it AS (SELECT g, count(v) AS n FROM ib GROUP BY g),
     vw AS (SELECT g, j, 2 * sum(v) {div} AS x FROM ib JOIN it USING (g), (SELECT unnest(range(64)) AS j) WHERE {_BIT} GROUP BY g, j), {outer}"""


_ORACLES = {
    "q1": _oracle("l_returnflag, l_linestatus, round(sum_qty, 2) AS sum_qty, round(sum_base, 1) AS sum_base, round(sum_disc, 1) AS sum_disc, round(sum_charge, 1) AS sum_charge, round(avg_qty, 6) AS avg_qty, round(avg_price, 3) AS avg_price, round(avg_disc, 8) AS avg_disc, n", _BY, _Q1_VALUES, f"{_LO} WHERE l_shipdate <= TIMESTAMP '1998-09-02'", "o_custkey"),
    "q5": _oracle("n_name, round(revenue, 1) AS revenue", {"n_name": "n_name"}, {"revenue": ("sum", _REV)}, _C5, "c_custkey"),
    "q6": _oracle("round(revenue, 2) AS revenue", {}, {"revenue": ("sum", "l_extendedprice * l_discount")}, f"{_LO} WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24", "o_custkey"),
    "q7": _oracle("supp_nation, cust_nation, CAST(yr AS INTEGER) AS yr, round(revenue, 1) AS revenue", {"supp_nation": "n1.n_name", "cust_nation": "n2.n_name", "yr": "year(l_shipdate)"}, {"revenue": ("sum", _REV)}, _C7, "c_custkey"),
    "q8": _ratio("share", "1", {"yr": "CAST(year(o_orderdate) AS INTEGER)"}, f"CASE WHEN s_nationkey < 5 THEN {_REV} ELSE 0 END", _REV, f"{_LO} JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey", "o_custkey"),
    "q13": _oracle("c_count, custdist", {"c_count": "c_count"}, {"custdist": ("count", "1")}, "(SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)", "c_custkey"),
    "q14": _ratio("promo", "100.0", {}, f"CASE WHEN p_size > 25 THEN {_REV} ELSE 0 END", _REV, f"{_LO} JOIN part ON l_partkey = p_partkey", "o_custkey"),
    "q15": _oracle("l_suppkey, round(revenue, 1) AS revenue", {"l_suppkey": "l_suppkey"}, {"revenue": ("sum", _REV)}, _LO, "o_custkey"),
    "q17": _oracle("round(total, 1) AS total", {}, {"total": ("sum", "l_extendedprice")}, "kept", "o_custkey", before=_vote_oracle(f"kept AS (SELECT l_extendedprice, o_custkey FROM (SELECT l_orderkey, l_linenumber, o_custkey, l_extendedprice, count(*) FILTER (WHERE l_quantity < 0.9 * x) AS c FROM {_LO} JOIN part ON p_partkey = l_partkey JOIN vw ON g = p_partkey WHERE p_size < 20 GROUP BY ALL) WHERE c >= 32),", "l_partkey", "l_quantity", _LO, "o_custkey", True)),
    "q19": _oracle("round(revenue, 1) AS revenue", {}, {"revenue": ("sum", _REV)}, f"{_LO} JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 30 AND l_quantity BETWEEN 10 AND 20)", "o_custkey"),
    "q20": "WITH " + _vote_oracle("kept AS (SELECT p_partkey, count(*) FILTER (WHERE p_size * 30 > 0.5 * x) AS c FROM part JOIN vw ON g = p_partkey GROUP BY p_partkey)", "l_partkey", "l_quantity", _LO, "o_custkey", False) + " SELECT p_partkey FROM kept WHERE c >= 32",
    "q22": _oracle("c_mktsegment, n, round(bal, 2) AS bal", {"c_mktsegment": "c_mktsegment"}, {"n": ("count", "1"), "bal": ("sum", "c_acctbal")}, "kept", "c_custkey", before=_vote_oracle("kept AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM (SELECT c_custkey, c_mktsegment, c_acctbal, count(*) FILTER (WHERE c_acctbal > x) AS c FROM customer, vw WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY ALL) WHERE c >= 32),", "1", "c_acctbal", "customer WHERE c_acctbal > 0", "c_custkey", True)),
    "having": _oracle("o_orderpriority, n", {"o_orderpriority": "o_orderpriority"}, {"n": ("count", "1")}, "orders", "o_custkey", after="WHERE n > 10"),
    "top_k": _oracle("o_orderpriority, n", {"o_orderpriority": "o_orderpriority"}, {"n": ("count", "1")}, "orders", "o_custkey", after="ORDER BY n DESC, o_orderpriority LIMIT 3"),
    "semi_join": _oracle("n", {}, {"n": ("count", "1")}, "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "o_custkey"),
    "union_below": _oracle("n, round(p, 1) AS p", {}, {"n": ("count", "1"), "p": ("sum", "p")}, "(SELECT o_totalprice AS p, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_totalprice AS p, o_custkey FROM orders WHERE o_totalprice > 300000)", "o_custkey"),
    "union_of_answers": "SELECT * FROM (" + _oracle("n", {}, {"n": ("count", "1")}, "orders WHERE o_totalprice > 200000", "o_custkey") + ") UNION ALL SELECT * FROM (" + _oracle("n", {}, {"n": ("count", "1")}, f"{_LO} WHERE l_quantity > 30", "o_custkey") + ")",
    "clicks": f"SELECT * FROM ({_oracle('event_type, n, round(total, 2) AS total', {'event_type': 'event_type'}, {'n': ('count', '1'), 'total': ('sum', 'value')}, 'events', 'user_id')}) JOIN ({_oracle('event_type, users', {'event_type': 'event_type'}, {'users': ('count', 'user_id')}, '(SELECT DISTINCT event_type, user_id FROM events)', 'user_id')}) USING (event_type)",
    "world_aggregates": _oracle("l_returnflag, l_linestatus, n, round(q, 2) AS q, round(d, 6) AS d, lo, round(hi, 2) AS hi", _BY, {"n": ("count", "1"), "q": ("sum", "l_quantity"), "d": ("avg", "l_discount"), "lo": ("min", "l_shipdate"), "hi": ("max", "l_extendedprice")}, _LO, "o_custkey"),
    "world_sum_wide": _oracle("l_returnflag, l_linestatus, round(q, 2) AS q", _BY, {"q": ("sum", "l_quantity")}, _LO, "o_custkey"),
    "distinct_aggregates": _oracle("l_returnflag, l_linestatus, parts, round(total, 2) AS total", _BY, {"parts": ("count", "l_linenumber"), "total": ("sum", "l_linenumber")}, f"(SELECT DISTINCT l_returnflag, l_linestatus, o_custkey, l_linenumber FROM {_LO})", "o_custkey"),
}

_ORACLES |= {
    "q4": _oracle("o_orderpriority, n", {"o_orderpriority": "o_orderpriority"}, {"n": ("count", "1")}, "orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)", "o_custkey"),
    "q9": _oracle("n_name, CAST(yr AS INTEGER) AS yr, round(profit, 1) AS profit", {"n_name": "n_name", "yr": "year(o_orderdate)"}, {"profit": ("sum", _PROFIT)}, f"{_LO} JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 25", "o_custkey"),
    "q12": _oracle("l_linestatus, CAST(high AS BIGINT) AS high, CAST(low AS BIGINT) AS low", {"l_linestatus": "l_linestatus"}, {"high": ("sum", _HIGH), "low": ("sum", f"1 - {_HIGH}")}, f"{_LO} WHERE l_quantity < 20", "o_custkey"),
    "q21": _oracle("s_name, numwait", {"s_name": "s_name"}, {"numwait": ("count", "1")}, f"supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND s_nationkey < 10 AND {_WAITS}", "o_custkey"),
    "click_count": _oracle("n", {}, {"n": ("count", "1")}, "events", "user_id"),
    "click_stats": _oracle("round(total, 2) AS total, n, round(mean, 6) AS mean", {}, {"total": ("sum", "value"), "n": ("count", "1"), "mean": ("avg", "value")}, "events WHERE value <> 0", "user_id"),
    "click_users": _oracle("users", {}, {"users": ("count", "user_id")}, "(SELECT DISTINCT user_id FROM events)", "user_id"),
    "click_range": _oracle("lo, hi", {}, {"lo": ("min", "ts"), "hi": ("max", "ts")}, "events", "user_id"),
    "click_hours": _oracle("h, n", {"h": "CAST(hour(ts) AS INTEGER)"}, {"n": ("count", "1")}, "events", "user_id", after="ORDER BY n DESC, h LIMIT 10"),
    "click_kinds": _oracle("event_type, h, n, round(mean, 6) AS mean", {"event_type": "event_type", "h": "CAST(hour(ts) AS INTEGER)"}, {"n": ("count", "1"), "mean": ("avg", "value")}, "events WHERE event_type LIKE '%i%'", "user_id", after="WHERE n > 4"),
}


_SIGNED = "CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - 18446744073709551616 ELSE {x}::HUGEINT END AS BIGINT)"


def _s(x: str) -> str:
    return _SIGNED.format(x=f"({x})")


def _bits(what: str, digits: int, s: Settings) -> str:
    """What `drawn_bits` gives, in SQL."""
    return f"('0x' || substr(md5('{signed(s.seed_used())}|{signed(s.query_hash)}|' || {what}), 1, {digits}))::UBIGINT"


def _uniform(mask: str, draw: int, s: Settings) -> str:
    return f"((CAST({_bits(f"{mask} || '|{draw}'", 13, s)} AS DOUBLE) + 1) / 4503599627370496)"


def _release(worlds: str, mask: str, s: Settings) -> str:
    """One of a list of numbers, with noise by their variance."""
    normal = f"sqrt(-2 * ln({_uniform(mask, 1, s)})) * cos(2 * pi() * {_uniform(mask, 2, s)})"
    return f"({worlds}[CAST({s.query_hash}::UBIGINT % len({worlds})::UBIGINT AS BIGINT) + 1] + sqrt(list_var_samp({worlds}) / (2 * {s.mi})) * {normal})"


def _noised_oracle(select: str, groups: dict[str, str], values: dict[str, tuple[str, str]], rows: str, key: str, s: Settings) -> str:
    """SQL of one private aggregate with noise; no value is null, so all its lists have one mask."""
    g = ", ".join(f"{e} AS {n}" for n, e in groups.items())
    names = ", ".join(groups)
    world = {"count": "CAST(count(v_{n}) AS DOUBLE)", "sum": "sum(v_{n})", "avg": "sum(v_{n})"}
    mask = _s("m")
    lists = ", ".join(f"list(w_{n} ORDER BY j) AS l_{n}" for n in values)
    out = []
    for n, (k, _) in values.items():
        x = "2 * " + _release(f"list_transform(l_{n}, lambda x: x / t)" if k == "avg" else f"l_{n}", "k", s)
        out.append((f"CAST(round({x}) AS BIGINT)" if k == "count" else x) + f" AS {n}")
    kept = f"64 - bit_count(CAST(k AS BIGINT)) <= CAST({_bits('k', 15, s)} % 64 AS BIGINT)"
    return f"""
WITH b AS (SELECT {g}, xor(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 16))::UBIGINT, {s.query_hash}::UBIGINT) AS k, {", ".join(f"{e} AS v_{n}" for n, (_, e) in values.items())} FROM {rows}),
     t AS (SELECT {names}, count(*) AS t FROM b GROUP BY {names}),
     w AS (SELECT {names}, j, {", ".join(world[k].format(n=n) + f" AS w_{n}" for n, (k, _) in values.items())} FROM b, (SELECT unnest(range(64)) AS j) WHERE {_BIT} GROUP BY {names}, j),
     l AS (SELECT {names}, sum(1::HUGEINT << j) AS m, {lists} FROM w GROUP BY {names}),
     r AS (SELECT *, CAST({mask} AS VARCHAR) AS k FROM l JOIN t USING ({names}))
SELECT {select} FROM (SELECT {names}, {", ".join(f"CASE WHEN {kept} THEN {x.rsplit(' AS ', 1)[0]} END AS {x.rsplit(' AS ', 1)[1]}" for x in out)} FROM r)
"""


_FIRST = replace(NOISED, query_number=1)
_ORACLES |= {
    "q1_noised": _noised_oracle("l_returnflag, l_linestatus, round(sum_qty, 0) AS sum_qty, round(sum_base, -2) AS sum_base, round(avg_disc, 6) AS avg_disc, n", _BY, {"sum_qty": ("sum", "l_quantity"), "sum_base": ("sum", "l_extendedprice"), "avg_disc": ("avg", "l_discount"), "n": ("count", "1")}, f"{_LO} WHERE l_shipdate <= TIMESTAMP '1998-09-02'", "o_custkey", _FIRST),
}


def _counters_oracle(kind: str) -> str:
    x = {"count": "2.0 * nullif(count(v), 0)", "sum": "2 * sum(v)", "avg": "2 * sum(v) / any_value(n)", "min": "min(v)", "max": "max(v)"}[kind]
    return f"""
WITH b AS (SELECT l_returnflag, l_linestatus, {_h("o_custkey")} AS k, l_quantity AS v FROM {_LO}),
     t AS (SELECT l_returnflag, l_linestatus, count(v) AS n FROM b GROUP BY 1, 2),
     w AS (SELECT l_returnflag, l_linestatus, j, {x} AS x FROM b JOIN t USING (l_returnflag, l_linestatus), (SELECT unnest(range(64)) AS j) WHERE {_BIT} GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, CAST(64 AS BIGINT) AS n, {", ".join(f"round(max(x) FILTER (WHERE j = {i}), 2) AS c{i}" for i in range(64))} FROM w GROUP BY 1, 2
"""


def _list_oracle(kind: str) -> str:
    x = {"count": "CAST(count(x) AS DOUBLE)"}.get(kind, f"{kind}(x)")
    return f"""
WITH b AS (SELECT l_returnflag, l_linestatus, {_h("o_custkey")} AS k, l_quantity AS v FROM {_LO}),
     w AS (SELECT l_returnflag, l_linestatus, j, 2 * sum(v) AS x FROM b, (SELECT unnest(range(64)) AS j) WHERE {_BIT} GROUP BY 1, 2, 3),
     l AS (SELECT l_returnflag, j, {x} AS y FROM w GROUP BY 1, 2)
SELECT l_returnflag, {", ".join(f"round(max(y) FILTER (WHERE j = {i}), 2) AS c{i}" for i in range(64))} FROM l GROUP BY 1
"""


_K = "('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16))::UBIGINT"
_W = f"""
WITH c AS (SELECT c_custkey, {_K} AS k FROM customer),
     w AS (SELECT c_custkey, k, j, CASE WHEN {_BIT} THEN CAST(c_custkey * (j + 1) % 97 AS DOUBLE) END AS x FROM c, (SELECT unnest(range(64)) AS j)),
     s AS (SELECT c_custkey, any_value(k) AS k, sum(CASE WHEN x > 30 THEN 1::HUGEINT << j ELSE 0 END) AS m, count(*) FILTER (WHERE x IS NULL OR x > 5) AS l, arg_min(x, j) FILTER (WHERE x IS NOT NULL) AS f FROM w GROUP BY c_custkey)
"""




def _two(k: str) -> str:
    """The count over two units; k: how their hashes meet, before the query's."""
    own = lambda c: f"('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 16))::UBIGINT"
    again = own(_s(own("l_suppkey")))
    key = k.format(a=own("o_custkey"), a_own=own("o_custkey"), b=again, c=own("l_suppkey"))
    return _oracle("l_returnflag, n", {"l_returnflag": "l_returnflag"}, {"n": ("count", "1")}, _LO, "o_custkey").replace(_h("o_custkey"), f"xor({key}, {Q}::UBIGINT)")


_ORACLES |= {f"{k}_counters": _counters_oracle(k) for k in ("count", "sum", "avg", "min", "max")}
_ORACLES |= {f"{k}_list": _list_oracle(k) for k in ("count", "sum", "avg", "min", "max")}
_ORACLES |= {
    "votes": f"""{_W} SELECT c_custkey, {_s("m")} AS mask, bit_count(k) >= 32 AS by_mask, bit_count(k) * (CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 1.0 END) >= 32 AS by_corrected, l >= 32 AS by_list,
       {_s("k & m::UBIGINT")} AS both, {_s("k | m::UBIGINT")} AS either, {_s("xor(k, 18446744073709551615::UBIGINT)")} AS neither, CAST(64 AS BIGINT) AS filled, round(f, 4) AS released FROM s""",
    "comparisons": f"""{_W} SELECT c_custkey, {", ".join(f"count(*) FILTER (WHERE c_custkey % 97 {o} x) * 1.5 >= 32 AS {n}" for n, o in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>")))} FROM w GROUP BY c_custkey""",
    "samples": f"""WITH x AS (SELECT c_custkey, list_transform(range(1, 129), lambda i: CAST(c_custkey * i % 31 AS DOUBLE)) AS x FROM customer)
       SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN round({_release("x", "array_to_string(list_transform(x, lambda v: CAST(CAST(v AS DECIMAL(38, 6)) AS VARCHAR)), ',')", NOISED)}, 4) END AS value FROM x""",
    "two_units": _two("xor({a}, {b})"),
    "two_units_and": _two("{a_own} & {c}"),
    "utility_diff": "WITH p AS (" + _oracle("*", {"l_returnflag": "l_returnflag"}, {"n": ("count", "1"), "q": ("sum", "l_quantity")}, _LO, "o_custkey") + "), e AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, CAST(round(100 * abs(e.n - p.n) / e.n) AS BIGINT) AS n, round(100 * abs(e.q - p.q) / abs(e.q), 4) AS q FROM p JOIN e USING (l_returnflag)",
    "streamed_windows": _oracle("start, event_type, n, round(total, 2) AS total", {"start": "date_trunc('day', ts)", "event_type": "event_type"}, {"n": ("count", "value"), "total": ("sum", "value")}, "events", "user_id"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"q1": _sql(Q1), "q5": _sql(Q5), "q6": _sql(Q6), "q7": _sql(Q7), "q8": _sql(Q8), "q13": _sql(Q13), "q14": _sql(Q14), "q15": _sql(Q15), "q17": _sql(Q17), "q19": _sql(Q19), "q20": _sql(Q20), "q22": _sql(Q22), "having": _sql(HAVING), "top_k": _sql(TOP), "semi_join": _sql(SEMI), "union_below": _sql(UNION_BELOW), "union_of_answers": _sql(UNION), "clicks": _sql(CLICKS)}
    out |= {"world_aggregates": _manual, "world_sum_wide": _wide, "distinct_aggregates": _distinct}
    out |= {f"{k}_counters": _counters(k) for k in ("count", "sum", "avg", "min", "max")}
    out |= {f"{k}_list": _list_of(k) for k in ("count", "sum", "avg", "min", "max")}
    out |= {"votes": _votes, "comparisons": _comparisons, "samples": _samples, "utility_diff": _diff, "streamed_windows": _stream}
    out |= {"q1_noised": _sql(Q1_NOISED, settings=NOISED), "two_units": _sql(TWO, two_units), "two_units_and": _sql(TWO, two_units, pac_conjunctive_units="true")}
    out |= {"q4": _sql(Q4), "q9": _sql(Q9), "q12": _sql(Q12), "q21": _sql(Q21)}
    out |= {"click_count": _sql(CLICK_COUNT), "click_stats": _sql(CLICK_STATS), "click_users": _sql(CLICK_USERS), "click_range": _sql(CLICK_RANGE), "click_hours": _sql(CLICK_HOURS), "click_kinds": _sql(CLICK_KINDS)}
    return out


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
