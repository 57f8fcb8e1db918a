"""The engine's registered queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import formatting, keys, rules
from lakeloom.operators import aggregates as A
from lakeloom.operators import relational as R
from lakeloom.operators import waits
from lakeloom.operators import windows as W
from lakeloom.plans import costs, workloads
from lakeloom.session import load
from lakeloom.sources import metrics, transactions
from lakeloom.streaming import votes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query with the SQL that DuckDB runs on the same tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a positive balance and their nations."""
    customer = R.select_where(load(spark, sf_dir, "customer"), [("c_acctbal", ">", 0.0)])
    return R.project(R.join_on(customer, load(spark, sf_dir, "nation"), [("c_nationkey", "=", "n_nationkey")]), ["c_name", "n_name", "c_acctbal"])


@query("SELECT c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def customer_nation(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("SELECT r_regionkey, r_name FROM region")
def scan_region(spark, sf_dir):
    return load(spark, sf_dir, "region").select("r_regionkey", "r_name")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup_order(spark, sf_dir):
    return R.point_lookup(load(spark, sf_dir, "orders"), "o_orderkey", 42)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag = 'R'")
def filter_conj(spark, sf_dir):
    rows = R.select_where(load(spark, sf_dir, "lineitem"), [("l_quantity", ">=", 30.0), ("l_discount", "<", 0.05), ("l_returnflag", "=", "R")])
    return R.project(rows, ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
def filter_col_col(spark, sf_dir):
    return R.project(R.select_where(load(spark, sf_dir, "lineitem"), [("l_tax", ">", F.col("l_discount"))]), ["l_orderkey", "l_linenumber", "l_tax", "l_discount"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def filter_ne(spark, sf_dir):
    return R.project(R.select_where(load(spark, sf_dir, "nation"), [("n_regionkey", "<>", 1)]), ["n_nationkey", "n_name"])


@query("SELECT p_brand, p_partkey, p_brand AS p_brand_2 FROM part")
def project_reorder(spark, sf_dir):
    return R.project(load(spark, sf_dir, "part"), ["p_brand", "p_partkey", ("p_brand", "p_brand_2")])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = left('BUILDINGXX', 8)")
def char_truncate_match(spark, sf_dir):
    return R.project(R.select_where(load(spark, sf_dir, "customer"), [("c_mktsegment", "=", formatting.char_bytes("BUILDINGXX", 8))]), ["c_custkey", "c_mktsegment"])


@query("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark, sf_dir):
    return R.project(R.join_on(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), [("o_custkey", "=", "c_custkey")]), ["o_orderkey", "c_custkey", "c_name", "o_totalprice"])


@query("SELECT r_name, n_name FROM region, nation WHERE n_regionkey > r_regionkey")
def join_theta(spark, sf_dir):
    return R.project(R.join_on(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"), [("n_regionkey", ">", "r_regionkey")]), ["r_name", "n_name"])


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate")
def join_multi_cond(spark, sf_dir):
    both = R.join_on(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"), [("l_orderkey", "=", "o_orderkey"), ("l_shipdate", ">", "o_orderdate")])
    return R.project(both, ["l_orderkey", "l_linenumber", "o_custkey"])


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return R.project(R.join_on(load(spark, sf_dir, "region"), load(spark, sf_dir, "nation"), []), ["r_regionkey", "r_name", "n_nationkey", "n_name"])


@query("SELECT DISTINCT l_partkey + 1 AS p_partkey FROM lineitem WHERE l_partkey + 1 IN (SELECT p_partkey FROM part)")
def lookup_join_found(spark, sf_dir):
    wanted = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("p_partkey")).distinct()
    return R.lookup_found(wanted, load(spark, sf_dir, "part"), "p_partkey")


@query("SELECT DISTINCT l_partkey + 1 AS p_partkey FROM lineitem WHERE l_partkey + 1 NOT IN (SELECT p_partkey FROM part)")
def lookup_join_missing(spark, sf_dir):
    wanted = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("p_partkey")).distinct()
    return R.lookup_missing(wanted, load(spark, sf_dir, "part"), "p_partkey")


@query("SELECT e.event_id, c.c_name, c.c_custkey IS NOT NULL AS found FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def lookup_flagged(spark, sf_dir):
    ops = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    return R.lookup(ops, load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("event_id", "c_name", "found")


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS INT) AS place FROM nation")
def order_by_desc(spark, sf_dir):
    rows = W.numbered(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.desc("n_name"))
    return R.ordered(rows.withColumn("place", F.col("place").cast("int")), "n_name", descending=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(spark, sf_dir):
    return R.top_k(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("""WITH last_orders AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20)
SELECT count(DISTINCT l_partkey) AS low_stock FROM lineitem JOIN last_orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 15""")
def stock_level(spark, sf_dir):
    last = R.top_k(load(spark, sf_dir, "orders").select("o_orderkey"), 20, F.desc("o_orderkey"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(F.broadcast(last), F.col("l_orderkey") == F.col("o_orderkey"))
    low = load(spark, sf_dir, "part").where("p_size < 15").select("p_partkey")
    return lines.join(low, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.countDistinct("l_partkey").alias("low_stock"))


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_orderkey")
def sum_per_order(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT o_custkey, min(o_orderkey) AS oldest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def oldest_open_order(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("oldest"))


@query("""SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_order_per_customer(spark, sf_dir):
    return W.latest(load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""SELECT c_mktsegment, c_name, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS i,
count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE i = ceil(n / 2.0)""")
def median_position_customer(spark, sf_dir):
    return W.position_in_group(load(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey"), ["c_mktsegment"], ["c_name", "c_custkey"], 1, 2)


@query("""SELECT event_type, count(*) AS attempts, CAST(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS commits,
round(1 - sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) / count(*), 6) AS abort_ratio FROM events GROUP BY event_type""")
def abort_ratio_by_type(spark, sf_dir):
    return A.ratio_by(load(spark, sf_dir, "events"), ["event_type"], F.col("value") >= 20)


@query("""SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = n * 90 // 100 THEN value END) AS p90 FROM
(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
GROUP BY event_type""")
def latency_p50_p90(spark, sf_dir):
    return A.index_pick(load(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", {"p50": (1, 2), "p90": (90, 100)})


@query("""SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS mean_price,
CASE WHEN count(l_extendedprice) = count(*) THEN round(sum(l_extendedprice), 2) END AS guarded FROM lineitem GROUP BY l_returnflag""")
def weighted_mean_guarded(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return df.agg(F.round(A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean_price"), F.round(A.guarded_sum(F.col("l_extendedprice"), F.count("*")), 2).alias("guarded"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_phase_path(spark, sf_dir):
    return A.rollup_matrix(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT time_bucket(INTERVAL 2 SECONDS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS events, count(*) / 2.0 AS per_second FROM events GROUP BY 1")
def tps_2s_window(spark, sf_dir):
    return A.rate_by_window(load(spark, sf_dir, "events"), "ts", 2)


@query("""SELECT count(*) AS events, count(*) / 86400.0 AS per_second FROM events
WHERE ts >= (TIMESTAMP '2024-01-02 00:00:00') AND ts < (TIMESTAMP '2024-01-03 00:00:00')""")
def rate_in_fixed_window(spark, sf_dir):
    return A.rate_in_bounds(load(spark, sf_dir, "events"), "ts", "2024-01-02 00:00:00", "2024-01-03 00:00:00")


@query("""SELECT user_id, round(max(d), 6) AS peak, round(avg(d), 6) AS mean FROM
(SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id""")
def sample_delta_peak(spark, sf_dir):
    steps = W.deltas(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value")
    return steps.groupBy("user_id").agg(F.round(F.max("delta"), 6).alias("peak"), F.round(F.avg("delta"), 6).alias("mean"))


@query("SELECT max(a) AS begin, min(b) AS \"end\" FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY event_type)")
def interior_window(spark, sf_dir):
    return W.interior_window(load(spark, sf_dir, "events"), "event_type", "ts")


@query("SELECT user_id, event_type, bool_or(value > 50) AS is_write, count(*) AS accesses FROM events GROUP BY user_id, event_type")
def dedupe_or_flag(spark, sf_dir):
    return A.deduped_flags(load(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") > 50).alias("is_write")), ["user_id", "event_type"], "is_write")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS writers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def distinct_writers(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("writers")).where("writers > 1")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), h AS (SELECT n FROM c ORDER BY n DESC, user_id LIMIT 10)
SELECT CAST((SELECT sum(n) FROM h) AS BIGINT) AS hot_events, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total_events, round((SELECT sum(n) FROM h) / (SELECT sum(n) FROM c), 6) AS ratio""")
def hot_key_ratio(spark, sf_dir):
    return A.hot_ratio(load(spark, sf_dir, "events"), "user_id", 10)


_RUNS = """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
r AS (SELECT user_id, event_type, CAST(island AS BIGINT) AS island, count(*) AS accesses FROM i GROUP BY user_id, event_type, island)"""


@query(_RUNS + " SELECT user_id, event_type, island, accesses FROM r")
def hold_islands(spark, sf_dir):
    return W.islands(load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_type")


@query(_RUNS + """ SELECT event_type, count(*) AS holds, CAST(sum(accesses) AS BIGINT) AS accesses, max(accesses) AS max_accesses,
CAST(sum(CASE WHEN accesses > 1 THEN 1 ELSE 0 END) AS BIGINT) AS reused_holds, round(sum(accesses) / count(*), 6) AS accesses_per_hold FROM r GROUP BY event_type""")
def page_hold_statistics(spark, sf_dir):
    return W.hold_statistics(hold_islands(spark, sf_dir), ["event_type"])


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version_per_key(spark, sf_dir):
    return W.latest(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id <= 500) WHERE n = 1""")
def asof_version(spark, sf_dir):
    return W.as_of(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], 500, "event_id")


@query("""SELECT user_id, event_id, op, value FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'update' END AS op, value,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND op <> 'delete'""")
def redo_replay(spark, sf_dir):
    log = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("op"), "value")
    return W.replayed(log.union(log.where("event_id % 3 = 0")), ["user_id"], "event_id", "op")


@query("""WITH RECURSIVE s AS (SELECT user_id, value, epoch_us(ts) / 1000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT user_id, i, t, value AS m FROM s WHERE i = 1
UNION ALL SELECT s.user_id, s.i, s.t, CASE WHEN s.t - e.t <= 3600000 THEN 0.8 * e.m + 0.2 * s.value ELSE s.value END FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)
SELECT user_id, max(i) AS samples, round(max_by(m, i), 6) AS ewma FROM e GROUP BY user_id""")
def ewma_per_key(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("ms", W.wall_ms("ts"))
    return W.ewma(rows, ["user_id"], ["ts", "event_id"], "ms", "value", 0.2, 3_600_000).withColumn("ewma", F.round("ewma", 6))


@query("""WITH d AS (SELECT user_id, event_type, max(ts) AS t, FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS i FROM d)
SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS recent FROM r WHERE i <= 3 GROUP BY user_id""")
def last_distinct_types(spark, sf_dir):
    out = W.last_distinct(load(spark, sf_dir, "events"), ["user_id"], ["ts"], "event_type", 3)
    return out.select("user_id", F.array_join("recent", ",").alias("recent"))


_ACCESSES = """a AS (SELECT l_orderkey AS txn, CAST(l_suppkey % 7 AS INT) AS "table", CAST(l_partkey AS INT) AS page, l_quantity > 25 AS write, CAST(l_suppkey % 3 AS INT) AS home FROM lineitem)"""


@query(f"""WITH {_ACCESSES}, p AS (SELECT txn, "table", page, bool_or(write) AS write, min(home) AS home FROM a GROUP BY ALL),
z AS (SELECT txn, sum(CASE WHEN write THEN 2.0 ELSE 0.75 END) AS lazy, sum(CASE WHEN home = 0 THEN CASE WHEN write THEN 2.0 ELSE 0.75 END ELSE 0 END) AS shared FROM p GROUP BY txn),
c AS (SELECT txn, sum(CASE WHEN home <> 0 THEN CASE WHEN write THEN 0.9 ELSE 0.5 END ELSE 0 END) AS calls, count(DISTINCT CASE WHEN write THEN home END) AS writers FROM a GROUP BY txn)
SELECT txn, writers > 1 AS eligible, CAST(CASE WHEN writers > 1 THEN round(lazy, 4) ELSE 0 END AS DOUBLE) AS lazy_ms, CAST(CASE WHEN writers > 1 THEN round(calls + shared, 4) ELSE 0 END AS DOUBLE) AS twopc_ms,
CAST(CASE WHEN writers > 1 THEN 2 ELSE 0 END AS DOUBLE) AS commit_delta_ms, writers > 1 AND round(lazy, 4) > round(calls + shared, 4) + 2 AS twopc FROM z JOIN c USING (txn)""")
def cost_choice(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    access = rows.select(F.col("l_orderkey").alias("txn"), (F.col("l_suppkey") % 7).cast("int").alias("table"), F.col("l_partkey").cast("int").alias("page"), (F.col("l_quantity") > 25).alias("write"), (F.col("l_suppkey") % 3).cast("int").alias("home"))
    known = spark.createDataFrame([(None, None, "write", 2.0), (None, None, "read", 0.75), (None, None, "remote_write", 0.9)], "table int, page int, kind string, ms double")
    out = costs.decide(access, known, 0)
    lazy, twopc = F.round("lazy_ms", 4), F.round("twopc_ms", 4)
    return out.select("txn", "eligible", lazy.alias("lazy_ms"), twopc.alias("twopc_ms"), "commit_delta_ms", (F.col("eligible") & (lazy > twopc + F.col("commit_delta_ms"))).alias("twopc"))


_EDGES = "SELECT DISTINCT l_suppkey AS waiter, l_suppkey * 7 % 11 + l_linenumber % 2 AS holder FROM lineitem"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w(txn, here, steps) AS (SELECT waiter, holder, 1 FROM e
UNION SELECT w.txn, e.holder, w.steps + 1 FROM w JOIN e ON w.here = e.waiter WHERE w.steps < 16 AND w.txn <> w.here)
SELECT txn, CAST(min(steps) AS INT) AS cycle_length FROM w WHERE txn = here GROUP BY txn""")
def deadlock_cycles(spark, sf_dir):
    edges = load(spark, sf_dir, "lineitem").selectExpr("l_suppkey waiter", "l_suppkey * 7 % 11 + l_linenumber % 2 holder")
    return waits.deadlock_cycles(edges)


@query("""SELECT o_orderkey, CAST(o_custkey % 4 AS BIGINT) * 10 + o_orderkey % 10 AS district_key, ((CAST(o_custkey % 4 AS BIGINT) * 10 + o_orderkey % 10) << 32) | o_custkey AS customer_key,
((CAST(o_custkey % 4 AS BIGINT) * 10 + o_orderkey % 10) * 10000000 + o_orderkey) * 15 + 3 AS line_key,
(((CAST(o_custkey % 4 AS BIGINT) * 10 + o_orderkey % 10) * 3000 + o_custkey) << 20) | (CAST(o_custkey % 4 AS BIGINT) * 10 + o_orderkey % 10) AS history_key,
o_orderkey + CAST(o_custkey % 4 AS BIGINT) * 100000 AS stock_key FROM orders""")
def composite_keys(spark, sf_dir):
    w, d, c, o = F.col("o_custkey") % 4, F.col("o_orderkey") % 10, F.col("o_custkey"), F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", keys.district_key(w, d).alias("district_key"), keys.customer_key(w, d, c).alias("customer_key"), keys.order_line_key(w, d, o, F.lit(3)).alias("line_key"),
        keys.history_key(w, d, w, d, c).alias("history_key"), keys.stock_key(w, o).alias("stock_key"),
    )


@query("SELECT p_partkey, CAST(((p_partkey - 1) // 400) % 3 AS INT) AS node FROM part WHERE p_partkey > 0")
def page_owner(spark, sf_dir):
    return load(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", keys.owner_node(F.col("p_partkey"), 400, 3).alias("node"))


@query("""SELECT p_partkey, CASE WHEN p_size - 5 >= 10 THEN p_size - 5 ELSE p_size - 5 + 91 END AS p_size, CASE WHEN p_retailprice >= 1000 THEN p_retailprice - 1000 ELSE p_retailprice END AS p_retailprice FROM part""")
def conditional_update_image(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", rules.restocked(F.col("p_size"), F.lit(5)).alias("p_size"), rules.debited(F.col("p_retailprice"), 1000).alias("p_retailprice"))


@query("SELECT c_custkey, CASE WHEN c_acctbal + 100 < 2000 THEN c_acctbal - 2001 ELSE c_acctbal - 2000 END AS balance FROM customer")
def overdraft_image(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", rules.checked_balance(F.lit(100), F.col("c_acctbal"), 2000).alias("balance"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 2)")
def delete_image(spark, sf_dir):
    return load(spark, sf_dir, "nation").where(~R.condition(("n_regionkey", "=", 2)))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_union_image(spark, sf_dir):
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return region.union(spark.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"))


@query("""SELECT c_custkey, printf('%.6f', c_acctbal) AS balance, lpad(CASE WHEN length(c_name) > 16 THEN left(c_name, 13) || '...' ELSE c_name END, 16, ' ') AS cell FROM customer""")
def format_cells(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", formatting.float_text(F.col("c_acctbal")).alias("balance"), formatting.cell(F.col("c_name")).alias("cell"))


@query("""WITH l AS (SELECT l_orderkey AS txn, 0 AS i, l_linenumber AS t, l_partkey AS k, CAST(l_quantity > 25 AS INT) AS w FROM lineitem)
SELECT txn, t AS table_id, k AS item_key, w <> 0 AS is_write, CASE WHEN w <> 0 THEN 'a,' || k END AS value FROM (SELECT txn, CAST(t AS BIGINT) AS t, k, w FROM l)""")
def parse_txn_line(spark, sf_dir):
    op = F.when(F.col("l_quantity") > 25, F.format_string("%d,%d,1,a,%d", "l_linenumber", "l_partkey", "l_partkey")).otherwise(F.format_string("%d,%d,0", "l_linenumber", "l_partkey"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn")).agg(F.array_join(F.collect_list(op), "; ").alias("line"))
    return transactions.parse_line(lines).select("txn", "table_id", "item_key", "is_write", "value")


@query("""SELECT l_orderkey AS txn, CAST(sum(CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END) AS BIGINT) AS reads, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS writes,
printf('OK: tx=%d reads=%d writes=%d', l_orderkey, CAST(sum(CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END) AS BIGINT), CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT)) AS reply FROM lineitem GROUP BY l_orderkey""")
def txn_summary(spark, sf_dir):
    ops = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), (F.col("l_quantity") > 25).alias("is_write"))
    return transactions.summary(ops, "txn")


@query("""SELECT key, CAST(idx AS INT) AS idx, round(CASE WHEN key IN ('throughput', 'pair') THEN sum(number) ELSE avg(number) END, 4) AS number FROM (
SELECT s_suppkey AS node, 'throughput' AS key, 0 AS idx, CAST(s_nationkey AS DOUBLE) AS number FROM supplier
UNION ALL SELECT s_suppkey, 'latency', 0, CAST(s_nationkey * 2 AS DOUBLE) FROM supplier
UNION ALL SELECT s_suppkey, 'pair', 0, CAST(s_nationkey AS DOUBLE) FROM supplier UNION ALL SELECT s_suppkey, 'pair', 1, CAST(s_suppkey AS DOUBLE) FROM supplier) GROUP BY key, idx""")
def metrics_kv_parse(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    text = F.explode(F.array(F.format_string("throughput=%d", "s_nationkey"), F.format_string("latency = %d", F.col("s_nationkey") * 2), F.format_string("pair=%d %d", "s_nationkey", "s_suppkey"), F.lit("name=text"), F.lit("no pair")))
    parsed = metrics.parse_lines(s.select(F.col("s_suppkey").alias("node"), text.alias("value")))
    return metrics.rolled_up(metrics.long_values(parsed, "node")).withColumn("number", F.round("number", 4))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE greatest(1, least(1000, ceil(1000 * pow(0.5, 1 / (1 - (p_size % 4) / 5.0))))) END AS BIGINT) AS hot_keys FROM part""")
def zipf_hot_count(spark, sf_dir):
    theta = (F.col("p_size") % 4) / 5.0
    return load(spark, sf_dir, "part").select("p_partkey", rules.hot_key_count(F.lit(1000), theta, F.lit(0.5)).alias("hot_keys"))


@query("""SELECT c_custkey, list_extract(n, CAST(c_custkey // 100 % 10 + 1 AS INT)) || list_extract(n, CAST(c_custkey // 10 % 10 + 1 AS INT)) || list_extract(n, CAST(c_custkey % 10 + 1 AS INT)) AS last_name
FROM customer, (SELECT ['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] AS n)""")
def last_names(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", rules.last_name(F.col("c_custkey")).alias("last_name"))


@query("""SELECT s_suppkey AS row, s_nationkey AS txn, coalesce(n_regionkey NOT IN (0, 1), true) AS locked FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def resolved_locks(spark, sf_dir):
    locks = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("txn"))
    status = F.when(F.col("n_regionkey") == 0, "committed").when(F.col("n_regionkey") == 1, "aborted").otherwise("running")
    return waits.resolved_locks(locks, load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("txn"), status.alias("status")))


@query("SELECT s_suppkey AS page, s_acctbal AS free FROM supplier WHERE s_acctbal >= 500 ORDER BY s_acctbal, s_suppkey LIMIT 1")
def free_space_page(spark, sf_dir):
    pages = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_acctbal").alias("free"))
    return R.top_k(R.select_where(pages, [("free", ">=", 500.0)]), 1, F.asc("free"), F.asc("page"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def bulk_load_sorted(spark, sf_dir):
    return R.bulk_sorted(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT count(*) AS locks, count(*) AS names FROM (SELECT DISTINCT l_linenumber, l_partkey FROM lineitem)")
def lock_key_names(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey").distinct()
    return rows.select(keys.lock_key(F.col("l_linenumber"), F.col("l_partkey")).alias("h")).agg(F.count("*").alias("locks"), F.countDistinct("h").alias("names"))


@query("""SELECT node, CAST(sum(n) AS BIGINT) AS records, CAST(sum(b) AS BIGINT) AS batches, round(sum(n) / sum(b), 6) AS records_per_batch FROM
(SELECT node, n, ceil(n / 16.0) AS b FROM (SELECT user_id % 4 AS node, time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n FROM events GROUP BY ALL)) GROUP BY node""")
def records_per_batch(spark, sf_dir):
    return A.flushes(load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("node"), "ts"), ["node"], "ts", "10 minutes", 16)


@query("""SELECT mode, count(*) AS transactions, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'eager' WHEN 1 THEN 'lazy' WHEN 3 THEN 'single'
ELSE CASE o_orderkey % 5 WHEN 2 THEN '2pc' ELSE 'mix' END || '/' || CASE o_custkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'cornus' ELSE 'cornus_opt' END END AS mode FROM orders) GROUP BY mode""")
def totals_by_mode(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderkey") % 5).alias("code"), (F.col("o_custkey") % 3).alias("variant"))
    return metrics.with_mode(rows, "code", "variant").groupBy("mode").agg(F.count("*").alias("transactions"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_orderkey AS txn, CASE WHEN NOT bool_and(l_quantity < 48) THEN 'abort' WHEN count(DISTINCT l_suppkey % 4) >= max(l_linenumber) THEN 'commit' ELSE 'timeout' END AS decision,
CAST(count(DISTINCT l_suppkey % 4) AS INT) AS voters FROM lineitem GROUP BY l_orderkey""")
def vote_decisions(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return votes.decided(rows.select(F.col("l_orderkey").alias("txn"), (F.col("l_suppkey") % 4).alias("node"), F.col("l_linenumber").alias("participants"), (F.col("l_quantity") < 48).alias("vote")))


_PAIRS = "SELECT a.c_custkey AS source, b.c_custkey AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1"


def _accounts(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    pairs = rows.selectExpr("c_custkey source", "c_custkey + 1 target").join(rows.select(F.col("c_custkey").alias("target")), "target", "left_semi")
    return rows.selectExpr("c_custkey acct_id", "c_acctbal bal"), rows.selectExpr("c_custkey acct_id", "double(c_nationkey) bal"), pairs


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT source FROM p) THEN 0 ELSE c_acctbal END AS s,
CASE WHEN c_custkey IN (SELECT source FROM p) THEN 0 ELSE c_nationkey END AS c FROM customer), t AS (SELECT target, c_acctbal + c_nationkey AS more FROM p JOIN customer ON source = c_custkey)
SELECT id AS acct_id, round(s, 2) AS savings, round(c + coalesce(more, 0), 2) AS checking FROM s LEFT JOIN t ON id = target""")
def bank_amalgamate(spark, sf_dir):
    savings, checking = workloads.amalgamate(*_accounts(spark, sf_dir))
    both = savings.withColumnRenamed("bal", "s").join(checking.withColumnRenamed("bal", "c"), "acct_id")
    return both.select("acct_id", F.round("s", 2).alias("savings"), F.round("c", 2).alias("checking"))


@query(f"""WITH p AS ({_PAIRS}), m AS (SELECT source, target FROM p JOIN customer ON source = c_custkey WHERE c_nationkey >= 5)
SELECT c_custkey AS acct_id, CAST(c_nationkey - CASE WHEN c_custkey IN (SELECT source FROM m) THEN 5 ELSE 0 END + CASE WHEN c_custkey IN (SELECT target FROM m) THEN 5 ELSE 0 END AS DOUBLE) AS bal FROM customer""")
def bank_send_payment(spark, sf_dir):
    _, checking, pairs = _accounts(spark, sf_dir)
    return workloads.send_payment(checking, pairs)


@query("SELECT round(sum(c_acctbal + c_nationkey), 2) AS before, round(sum(c_acctbal + c_nationkey), 2) AS after FROM customer")
def bank_total_is_kept(spark, sf_dir):
    s, c, pairs = _accounts(spark, sf_dir)
    s2, c2 = workloads.amalgamate(s, workloads.send_payment(c, pairs), pairs)
    total = lambda df, name: df.agg(F.round(F.sum("total"), 2).alias(name)).withColumn("_k", F.lit(1))
    return total(workloads.balances(s, c), "before").join(total(workloads.balances(s2, c2), "after"), "_k").drop("_k")


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), h AS (SELECT l_partkey FROM c ORDER BY n DESC, l_partkey LIMIT 100)
SELECT l_orderkey AS txn, count(*) AS total, count(h.l_partkey) AS hot, count(h.l_partkey) / count(*) >= 0.2 AS twopc FROM lineitem l LEFT JOIN h ON l.l_partkey = h.l_partkey GROUP BY l_orderkey""")
def hot_key_choice(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    hot = R.top_k(rows.groupBy("l_partkey").agg(F.count("*").alias("n")), 100, F.desc("n"), F.asc("l_partkey")).select("l_partkey", F.lit(True).alias("is_hot"))
    out = rows.join(hot, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("txn")).agg(F.count("*").alias("total"), F.count("is_hot").alias("hot"))
    return out.withColumn("twopc", costs.hot_key_decision(F.col("hot"), F.col("total"), costs.CostConfig().historical_threshold))
