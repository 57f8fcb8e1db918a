import math

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import formatting, rules
from lakeloom.operators import aggregates, windows
from lakeloom.operators import relational as R
from lakeloom.operators import waits
from lakeloom.plans import costs, workloads
from lakeloom.sources import generators, metrics, transactions


@pytest.fixture(scope="module")
def shop(spark):
    return {k: v.cache() for k, v in generators.order_entry(spark, 2).items()}


def test_generated_tables_are_whole_and_repeatable(spark, shop):
    want = {"warehouse": 2, "district": 10, "customer": 300, "history": 300, "orders": 300, "order_line": 3000, "item": 1000, "stock": 2000, "order_index": 300}
    assert {k: shop[k].count() for k in want} == want
    assert R.same_rows(shop["customer"], generators.order_entry(spark, 2)["customer"])
    assert generators.verified(shop["order_line"], shop["orders"], ["ol_w_id", "ol_d_id", "ol_o_id"], ["o_w_id", "o_d_id", "o_id"]).isEmpty()
    assert shop["order_index"].select("index_key").distinct().count() == 300
    assert shop["orders"].where("o_carrier_id > 0").count() + shop["new_orders"].count() == 300


def test_new_orders(spark, shop):
    orders = spark.createDataFrame([(0, 1, 5, 1), (0, 1, 6, 2), (1, 0, 7, 3)], "w int, d int, c int, seq int")
    lines = spark.createDataFrame([(0, 1, 1, 0, 3, 0, 5), (0, 1, 1, 1, 4, 1, 5), (0, 1, 2, 0, 3, 0, 5), (1, 0, 3, 0, 9, 1, 5)], "w int, d int, seq int, number int, i int, supply_w int, quantity int")
    out = workloads.new_order(orders, lines, shop["district"], shop["stock"])
    assert sorted((r.o_w_id, r.o_d_id, r.o_id, r.o_ol_cnt, r.o_all_local) for r in out["orders"].collect()) == [(0, 1, 30, 2, 0), (0, 1, 31, 1, 1), (1, 0, 30, 1, 1)]
    assert {(r.d_w_id, r.d_id): r.d_next_o_id for r in out["district"].collect()}[0, 1] == 32
    old = {(r.s_w_id, r.s_i_id): r for r in shop["stock"].collect()}
    new = {(r.s_w_id, r.s_i_id): r for r in out["stock"].collect()}
    rule = lambda q: q - 5 if q - 5 >= 10 else q - 5 + 91
    assert new[0, 3].s_quantity == rule(rule(old[0, 3].s_quantity)) and new[0, 3].s_ytd == 10 and new[0, 3].s_order_cnt == 2
    assert new[1, 4].s_remote_cnt == 1 and new[1, 5] == old[1, 5] and len(new) == len(old)
    assert out["order_line"].count() == 4 and out["new_orders"].count() == 3


def test_payment_delivery_status_and_stock_level(spark, shop):
    bad = shop["customer"].where("c_credit = 'BC'").first()
    paid = spark.createDataFrame([(0, 2, bad.c_w_id, bad.c_d_id, bad.c_id, 12.5, 1), (0, 3, bad.c_w_id, bad.c_d_id, bad.c_id, 2.25, 2)], "w int, d int, c_w int, c_d int, c int, amount double, seq int")
    out = workloads.payment(paid, shop["customer"], shop["warehouse"], shop["district"])
    after = out["customer"].where((F.col("c_w_id") == bad.c_w_id) & (F.col("c_d_id") == bad.c_d_id) & (F.col("c_id") == bad.c_id)).first()
    assert after.c_balance == bad.c_balance - 14.75 and after.c_payment_cnt == 3
    note = lambda d, a: f"({bad.c_id}, {bad.c_d_id}, {bad.c_w_id}, {d}, 0, {a:.2f})\n"
    assert after.c_data == (note(3, 2.25) + note(2, 12.5) + bad.c_data)[:500]
    assert out["warehouse"].where("w_id = 0").first().w_ytd == 300014.75 and out["history"].count() == 2
    names = {("w", r.w_id): r.w_name for r in shop["warehouse"].collect()} | {("d", r.d_w_id, r.d_id): r.d_name for r in shop["district"].collect()}
    assert {r.h_data for r in out["history"].collect()} == {f"{names['w', 0]}    {names['d', 0, d]}" for d in (2, 3)}
    sent = workloads.delivery(shop["new_orders"], shop["orders"], shop["order_line"], shop["customer"], 7)
    assert sent["new_orders"].count() == shop["new_orders"].count() - 10
    assert sent["orders"].where("o_id = 21 and o_carrier_id = 7").count() == 10
    owed = shop["order_line"].where("ol_o_id = 21").agg(F.sum("ol_amount")).first()[0]
    total = lambda df: df.agg(F.sum("c_balance")).first()[0]
    assert math.isclose(total(sent["customer"]), total(shop["customer"]) + owed)
    assert workloads.order_status(shop["orders"], shop["order_line"]).count() == 300 * 10
    low = {(r.w, r.d): r.low_stock for r in workloads.stock_level(shop["order_line"], shop["district"], shop["stock"], 40).collect()}
    stock = {(r.s_w_id, r.s_i_id): r.s_quantity for r in shop["stock"].collect()}
    want = {}
    for r in shop["order_line"].where("ol_o_id >= 10").collect():
        if stock[r.ol_w_id, r.ol_i_id] < 40:
            want.setdefault((r.ol_w_id, r.ol_d_id), set()).add(r.ol_i_id)
    assert low == {k: len(v) for k, v in want.items()}
    assert workloads.customer_by_name(shop["customer"]).count() == shop["customer"].select("c_w_id", "c_d_id", "c_last").distinct().count()


def test_bank_keeps_the_total(spark):
    t = generators.bank(spark, 50, 100.0)
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 2)], "source long, target long")
    s, c = workloads.amalgamate(t["savings"], t["checking"], pairs)
    total = lambda *dfs: sum(d.agg(F.sum("bal")).first()[0] for d in dfs)
    assert total(s, c) == total(*t.values()) and {r.acct_id: r.bal for r in c.collect()}[2] == 500.0
    paid = workloads.send_payment(c, pairs)
    assert total(paid) == total(c) and {r.acct_id: r.bal for r in paid.collect()}[1] == 0.0
    cheques = spark.createDataFrame([(7, 150), (8, 500)], "acct_id long, amount int")
    bal = {r.acct_id: r.bal for r in workloads.write_check(t["savings"], t["checking"], cheques).collect()}
    assert (bal[7], bal[8], bal[9]) == (-50.0, -401.0, 100.0)
    assert workloads.balances(s, c).agg(F.sum("total")).first()[0] == 10_000.0
    assert {r.acct_id: r.bal for r in workloads.deposit(t["checking"], spark.createDataFrame([(1, 5), (1, 6)], "acct_id long, amount int")).collect()}[1] == 111.0


def test_key_value_batches(spark):
    ops = generators.key_value_operations(spark, 200, rows=1000, theta=0.9, read_percent=50, size=5).cache()
    assert ops.count() == 1000 and ops.agg(F.max("item_key")).first()[0] < 1000
    by = {r.item_key: r["count"] for r in ops.groupBy("item_key").count().collect()}
    assert by[0] == max(by.values()) and by[0] > 30
    assert 400 < ops.where("is_write").count() < 600
    state = spark.range(5).select(F.col("id").alias("item_key"), F.lit("old").alias("v"))
    batch = transactions.parse_line(spark.createDataFrame([(1, "0,1,1,a,b;0,2,0"), (2, "0,1,1,c;0,9,0; ;bad"), (3, None)], "txn int, line string"))
    assert sorted((r.txn, r.op_seq, r.item_key, r.is_write, r.value) for r in batch.where("item_key is not null").collect()) == [(1, 0, 1, True, "a,b"), (1, 1, 2, False, None), (2, 0, 1, True, "c"), (2, 1, 9, False, None)]
    new, missing = transactions.executed(batch.where("item_key is not null").withColumn("op_seq", F.col("txn") * 10 + F.col("op_seq")), state, {"v": F.col("value_written")})
    assert {r.item_key: r.v for r in new.collect()} == {0: "old", 1: "c", 2: "old", 3: "old", 4: "old"} and [r.item_key for r in missing.collect()] == [9]


def test_metrics(spark, tmp_path):
    for node, text in enumerate(["throughput = 10\nlatency=2.5\ntry_commit=3 4\nname=a=b\nnoise\nbad=nan", "throughput=30\nlatency=3.5\ntry_commit=5 6\nonly=1"]):
        (tmp_path / f"node{node}").mkdir()
        (tmp_path / f"node{node}" / "result.txt").write_text(text)
    parsed = metrics.read_nodes(spark, f"{tmp_path}/node*/result.txt").cache()
    assert {(r.node, r.key): r.text for r in parsed.collect()}[0, "name"] == "a=b"
    values = metrics.long_values(parsed, "node")
    rolled = {(r.key, r.idx): r.number for r in metrics.rolled_up(values).collect()}
    assert rolled == {("throughput", 0): 40.0, ("latency", 0): 3.0, ("try_commit", 0): 8.0, ("try_commit", 1): 10.0, ("only", 0): 1.0}
    assert {r.key: r.total for r in metrics.totals(values, 2).collect()} == {"throughput": 40.0, "latency": 6.0, "try_commit": 8.0, "only": None}
    lines = spark.createDataFrame([("[2024-01-01 00:00:02.5] [Node 3] [Commit TPS] 12.5",), ("other",)], "value string")
    assert [(r.node, r.tps) for r in metrics.commit_rates(lines).collect()] == [(3, 12.5)]
    samples = spark.createDataFrame([("d", i, float(i), 10 * i * i, i) for i in range(6)], "device string, time int, monotonic_s double, reads long, writes long")
    r = metrics.device_rates(samples, 1, 4).first()
    assert (r.seconds, r.operations, r.peak, r.average) == (3.0, 153, 71.0, 51.0)
    for kind in ("csv", "tsv", "parquet", "json"):
        metrics.write_report(samples, f"{tmp_path}/out-{kind}", kind)
    assert spark.read.parquet(f"{tmp_path}/out-parquet").count() == 6


def test_cost_decisions(spark):
    access = spark.createDataFrame([(1, 0, 1, True, 0), (1, 0, 1, False, 0), (1, 0, 2, True, 1), (2, 0, 1, True, 1), (3, 0, 5, True, 0), (3, 0, 6, True, 1), (3, 0, 7, True, 2)], "txn int, table int, page int, write boolean, home int")
    known = spark.createDataFrame([(0, 2, "write", 8.0), (None, None, "write", 3.0), (None, None, "remote_write", 1.5)], "table int, page int, kind string, ms double")
    got = {r.txn: r for r in costs.decide(access, known, 0).collect()}
    assert not got[2].eligible and not got[2].twopc
    assert (got[1].lazy_ms, got[1].twopc_ms, got[1].commit_delta_ms, got[1].twopc) == (11.0, 4.5, 2.0, True)
    assert (got[3].lazy_ms, got[3].twopc_ms, got[3].twopc) == (9.0, 6.0, True)
    states = spark.createDataFrame([(1, 0, 2, True, False), (1, 0, 1, False, True)], "txn int, table int, page int, usable boolean, upgrade boolean")
    assert {r.txn: r.lazy_ms for r in costs.decide(access, known, 0, states=states).collect()}[1] == 1.0
    simple = costs.CostConfig(include_2pc_execution_cost=False)
    assert {r.txn: r.twopc_ms for r in costs.decide(access, known, 0, simple).collect()}[1] == 0.0
    phases = spark.createDataFrame([(1, 0, 0.5, 1.0, 2.0), (1, 1, 1.0, 2.0, 0.5)], "txn int, node int, rpc_ms double, prepare_ms double, commit_ms double")
    own = spark.createDataFrame([(1, 0.75, 2.0)], "txn int, backup_ms double, commit_ms double")
    assert costs.online_delta(phases, own).first().commit_delta_ms == 3.0 + 0.75 + 2.5 - 2.0
    with pytest.raises(ValueError):
        costs.CostConfig(rpc_rtt_ms=-1)


def test_rules_and_text(spark):
    row = spark.range(1).select(
        formatting.char_value(F.lit("straße!"), 6).alias("a"), formatting.cell(F.lit("x" * 20)).alias("b"), formatting.float_text(F.lit(90.125)).alias("c"), rules.last_name(F.lit(371)).alias("d"),
        rules.hot_key_count(F.lit(100), F.lit(0.5), F.lit(0.5)).alias("e"), rules.hot_key_count(F.lit(100), F.lit(1.5), F.lit(0.5)).alias("f"), rules.hot_key_count(F.lit(100), F.lit(0.5), F.lit(1.0)).alias("g"),
    ).first()
    assert tuple(row) == ("straß", " " * 0 + "xxxxxxxxxxxxx...", "90.125000", "PRICALLYOUGHT", 25, 1, 100)
    assert formatting.char_bytes("straße", 5) == "stra" and formatting.char_bytes("a\0b", 9) == "a"


def test_lock_waits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (6, 1), (7, 8), (9, 9), (None, 1)], "waiter int, holder int")
    want = {1: 2, 2: 2, 3: 3, 4: 3, 5: 3, 9: 1}
    assert {r.txn: r.cycle_length for r in waits.deadlock_cycles(edges).collect()} == want
    edges.where("waiter is not null").createOrReplaceTempView("wait_edges")
    assert {r.txn: r.cycle_length for r in spark.sql(waits.deadlock_sql("wait_edges")).collect()} == want
    assert waits.deadlock_cycles(edges.where("waiter > 99")).count() == 0


def test_cycles_of_any_length_are_found(spark):
    rows = [(i, (i + 1) % 40) for i in range(40)] + [(100, 101), (101, 0), (200, 201), (201, 200)]
    edges = spark.createDataFrame(rows, "waiter int, holder int")
    want = {i: 40 for i in range(40)} | {200: 2, 201: 2}
    assert {r.txn: r.cycle_length for r in waits.deadlock_cycles(edges).collect()} == want
    assert {r.txn for r in waits.deadlock_cycles(edges, 16).collect()} == {200, 201}


def test_generated_rows_have_all_their_columns(shop):
    want = {
        "warehouse": "w_id w_name w_street_1 w_street_2 w_city w_state w_zip w_tax w_ytd", "history": "h_c_id h_c_d_id h_c_w_id h_d_id h_w_id h_date h_amount h_data",
        "orders": "o_w_id o_d_id o_id o_c_id o_carrier_id o_ol_cnt o_all_local o_entry_d", "item": "i_id i_name i_price i_im_id i_data",
    }
    for name, columns in want.items():
        assert set(shop[name].columns) == set(columns.split())
    assert {f"s_dist_{k:02d}" for k in range(1, 11)} | {"s_data"} <= set(shop["stock"].columns)
    assert {"c_middle", "c_phone", "c_since", "c_credit_lim", "c_zip"} <= set(shop["customer"].columns)
    marked = shop["stock"].where("s_data like '%ORIGINAL%'").count()
    assert 100 < marked < 320 and shop["stock"].where("length(s_data) > 64").count() == 0
    assert shop["customer"].where("length(c_phone) <> 16 or c_zip not like '____11111'").count() == 0


def test_key_value_rows_hot_sets_locality_and_writers(spark):
    rows = generators.key_value(spark, 30)
    assert rows.count() == 30 and len(rows.columns) == 11 and rows.where("length(file_3) <> 100").count() == 0
    ops = generators.key_value_operations(spark, 400, rows=1000, size=5, hot_keys=10, hot_percent=70, nodes=4, writers=2).cache()
    assert 0.6 < ops.where("item_key < 10").count() / 2000 < 0.8 and ops.where("is_write").count() == 800 and ops.where("is_write").agg(F.max("op_seq")).first()[0] == 1
    assert sorted(r.node for r in ops.select("node").distinct().collect()) == [0, 1, 2, 3]
    near = generators.key_value_operations(spark, 200, rows=1000, size=5, nodes=4, local_percent=100)
    assert near.where("floor(item_key / 250) <> node").count() == 0


def test_bank_operations_have_their_shares(spark):
    ops = generators.bank_operations(spark, 4000, accounts=500, hot_accounts=5, hot_percent=50).cache()
    by = {r.kind: r["count"] for r in ops.groupBy("kind").count().collect()}
    assert set(by) == set(generators.BANK_MIX) and all(abs(by[k] - 40 * share) < 120 for k, share in generators.BANK_MIX.items())
    assert ops.where("source = target or source >= 500 or target >= 500").count() == 0
    assert 0.4 < ops.where("source < 5").count() / 4000 < 0.6
    long = generators.bank_operations(spark, 50, accounts=500, size=8)
    assert long.count() == 400 and long.groupBy("txn_id").agg(F.countDistinct("kind").alias("k")).where("k <> 1").count() == 0


def test_places_in_groups_with_nulls_ties_and_odd_sizes(spark):
    rows = [(g, v) for g in (None, "a", "b") for v in ([None, 3, 3, 3, 1, 9] if g else [7])]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: (r.low, r.mid, r.top) for r in aggregates.index_pick(df, ["g"], "v", {"low": (0, 1), "mid": (1, 2), "top": (99, 100)}).collect()}
    assert got == {None: (7, 7, 7), "a": (None, 3, 9), "b": (None, 3, 9)}  # nulls first
    big = spark.range(5000).selectExpr("id % 3 g", "id v").repartition(7)
    assert sorted((r.g, r.v) for r in windows.position_in_group(big, ["g"], ["v"], 1, 2).collect()) == [(0, 2499), (1, 2500), (2, 2498)]
    assert aggregates.index_pick(df.where("v > 99"), ["g"], "v", {"mid": (1, 2)}).count() == 0
    places = windows.numbered(big, F.desc("v"), F.asc("g"))
    assert places.where("place <> 5000 - v").count() == 0 and places.count() == 5000 and windows.numbered(big.where("v < 0"), F.asc("v")).count() == 0


def test_a_cost_choice_deals_accesses_out_once(spark):
    access = spark.createDataFrame([(1, 0, 1, True, 0)], "txn int, table int, page int, write boolean, home int")
    known = F.broadcast(spark.createDataFrame([(None, None, "write", 3.0)], "table int, page int, kind string, ms double"))
    plan = costs.decide(access, known, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(txn") == 1 and "hashpartitioning(kind" not in plan.split("BroadcastExchange")[0]


def test_shared_folder_must_be_named_outside_local_mode():
    from lakeloom import lineage

    class Fake:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(ValueError):
        lineage.shared_dir(Fake)
