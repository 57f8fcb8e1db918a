"""Workload tables from ranges: deterministic by seed, made where they are used, of any size.

Values are hashes of the row's key and the seed, so a lost task makes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import keys, rules

# The default scale of the order-entry tables.
DISTRICTS, CUSTOMERS, ITEMS, LINES = 5, 30, 1000, 10


def _draw(seed: int, *on: str) -> Column:
    """A uniform variate in [0, 1)."""
    return F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def _pick(seed: int, low: int, high: int, *on: str) -> Column:
    return (F.floor(_draw(seed, *on) * (high - low + 1)) + low).cast("bigint")


def _text(seed: int, size: int, *on: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), *on), 256), 1, size)


def _grid(spark: SparkSession, names: dict[str, int]) -> DataFrame:
    """All combinations of ids 0..n-1, from one range: digits of a mixed radix."""
    total = 1
    for n in names.values():
        total *= n
    df, left = spark.range(total), F.col("id")
    out = {}
    for name, n in reversed(names.items()):
        out[name] = (left % n).cast("int")
        left = F.floor(left / n)
    return df.select(*[out[name].alias(name) for name in names])


def _address(prefix: str, seed: int, *on: str) -> list[Column]:
    """street_1, street_2, city, state, zip."""
    zip_ = F.concat(F.lpad(_pick(seed + 54, 0, 9999, *on).cast("string"), 4, "0"), F.lit("11111"))
    made = {"street_1": _text(seed + 50, 16, *on), "street_2": _text(seed + 51, 16, *on), "city": _text(seed + 52, 16, *on), "state": F.upper(_text(seed + 53, 2, *on)), "zip": zip_}
    return [c.alias(f"{prefix}_{name}") for name, c in made.items()]


def _marked(data: Column, draw: Column) -> Column:
    """A tenth of the data fields hold the word ORIGINAL."""
    return F.when(draw < 0.1, F.concat(F.substring(data, 1, 10), F.lit("ORIGINAL"), F.substring(data, 19, 64))).otherwise(data)


#: When the generated tables were loaded, in seconds since 1970: parameters, so that rows can be made again.
LOADED = 1_700_000_000


def order_entry(spark: SparkSession, warehouses: int = 2, seed: int = 9324) -> dict[str, DataFrame]:
    """warehouse, district, customer, history, orders, new_orders, order_line, item, stock and the two index tables."""
    w = _grid(spark, {"w_id": warehouses}).select("w_id", _text(seed, 8, "w_id").alias("w_name"), *_address("w", seed, "w_id"), (F.round(_draw(seed, "w_id") * 0.2, 4)).alias("w_tax"), F.lit(300000.0).alias("w_ytd"))
    d = _grid(spark, {"d_w_id": warehouses, "d_id": DISTRICTS}).select("d_id", "d_w_id", _text(seed + 1, 8, "d_w_id", "d_id").alias("d_name"), *_address("d", seed + 100, "d_w_id", "d_id"), F.round(_draw(seed + 1, "d_w_id", "d_id") * 0.2, 4).alias("d_tax"), F.lit(30000.0).alias("d_ytd"), F.lit(CUSTOMERS).alias("d_next_o_id"))
    at = ("c_w_id", "c_d_id", "c_id")
    c = _grid(spark, dict(zip(at, (warehouses, DISTRICTS, CUSTOMERS)))).select(
        *at, _text(seed + 2, 12, *at).alias("c_first"), rules.last_name(F.when(F.col("c_id") < 1000, F.col("c_id")).otherwise(_pick(seed + 3, 0, 999, *at))).alias("c_last"),
        F.lit("OE").alias("c_middle"), *_address("c", seed + 200, *at), F.lpad(_pick(seed + 30, 0, 10**16 - 1, *at).cast("string"), 16, "0").alias("c_phone"), F.lit(LOADED).cast("bigint").alias("c_since"), F.lit(50000.0).alias("c_credit_lim"),
        F.when(_draw(seed + 4, *at) < 0.1, "BC").otherwise("GC").alias("c_credit"), F.round(_draw(seed + 5, *at) * 0.5, 4).alias("c_discount"), F.lit(-10.0).alias("c_balance"),
        F.lit(10.0).alias("c_ytd_payment"), F.lit(1).alias("c_payment_cnt"), F.lit(0).alias("c_delivery_cnt"), _text(seed + 6, 50, *at).alias("c_data"),
    )
    h = c.select(F.col("c_id").alias("h_c_id"), F.col("c_d_id").alias("h_c_d_id"), F.col("c_w_id").alias("h_c_w_id"), F.col("c_d_id").alias("h_d_id"), F.col("c_w_id").alias("h_w_id"), F.lit(LOADED).cast("bigint").alias("h_date"), F.lit(10.0).alias("h_amount"), _text(seed + 31, 24, "c_w_id", "c_d_id", "c_id").alias("h_data"))
    at = ("o_w_id", "o_d_id", "o_id")
    last_open = int(CUSTOMERS * 0.7)
    o = _grid(spark, dict(zip(at, (warehouses, DISTRICTS, CUSTOMERS)))).select(
        *at, ((F.col("o_id") * 7 + 3) % CUSTOMERS).cast("int").alias("o_c_id"), F.when(F.col("o_id") < last_open, _pick(seed + 7, 1, 10, *at)).otherwise(0).cast("int").alias("o_carrier_id"), F.lit(LINES).alias("o_ol_cnt"), F.lit(1).alias("o_all_local"), F.lit(LOADED).cast("bigint").alias("o_entry_d"),
    )
    n = o.where(F.col("o_id") >= last_open).select(F.col("o_id").alias("no_o_id"), F.col("o_d_id").alias("no_d_id"), F.col("o_w_id").alias("no_w_id"))
    at = ("ol_w_id", "ol_d_id", "ol_o_id", "ol_number")
    line = _grid(spark, dict(zip(at, (warehouses, DISTRICTS, CUSTOMERS, LINES)))).select(
        *at, (_pick(seed + 8, 1, ITEMS, *at) - 1).cast("int").alias("ol_i_id"), F.col("ol_w_id").alias("ol_supply_w_id"), F.lit(5).alias("ol_quantity"),
        F.when(F.col("ol_o_id") < last_open, F.lit(0.0)).otherwise(F.round(_draw(seed + 9, *at) * 9999.98 + 0.01, 2)).alias("ol_amount"),
        F.when(F.col("ol_o_id") < last_open, F.lit(LOADED)).otherwise(F.lit(0)).cast("bigint").alias("ol_delivery_d"), _text(seed + 32, 24, *at).alias("ol_dist_info"),
    )
    i = _grid(spark, {"i_id": ITEMS}).select("i_id", _text(seed + 10, 14, "i_id").alias("i_name"), F.round(_draw(seed + 10, "i_id") * 99 + 1, 2).alias("i_price"), _pick(seed + 33, 1, 10_000, "i_id").cast("int").alias("i_im_id"), _marked(_text(seed + 11, 50, "i_id"), _draw(seed + 34, "i_id")).alias("i_data"))
    s = _grid(spark, {"s_w_id": warehouses, "s_i_id": ITEMS}).select("s_i_id", "s_w_id", _pick(seed + 12, 10, 100, "s_w_id", "s_i_id").cast("int").alias("s_quantity"), F.lit(0).alias("s_ytd"), F.lit(0).alias("s_order_cnt"), F.lit(0).alias("s_remote_cnt"), *[_text(seed + 300 + k, 24, "s_w_id", "s_i_id").alias(f"s_dist_{k:02d}") for k in range(1, 11)], _marked(_text(seed + 35, 50, "s_w_id", "s_i_id"), _draw(seed + 36, "s_w_id", "s_i_id")).alias("s_data"))
    names = c.select(F.struct("c_w_id", "c_d_id", "c_last").alias("name"), "c_first", keys.customer_key(F.col("c_w_id"), F.col("c_d_id"), F.col("c_id")).alias("customer_key")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("c_first", "customer_key"))).alias("customers")).select("name.*", "customers")
    by_customer = o.select(keys.order_index_key(F.col("o_w_id"), F.col("o_d_id"), F.col("o_c_id"), F.col("o_id")).alias("index_key"), keys.order_key(F.col("o_w_id"), F.col("o_d_id"), F.col("o_id")).alias("order_key"))
    return {"warehouse": w, "district": d, "customer": c, "history": h, "orders": o, "new_orders": n, "order_line": line, "item": i, "stock": s, "customer_index": names, "order_index": by_customer}


def bank(spark: SparkSession, accounts: int = 300_000, balance: float = 1e9) -> dict[str, DataFrame]:
    """savings and checking accounts."""
    one = spark.range(accounts).select(F.col("id").alias("acct_id"), F.lit(balance).alias("bal"))
    return {"savings": one, "checking": one}


def key_value(spark: SparkSession, rows: int = 100_000, seed: int = 7) -> DataFrame:
    """user_id and ten fields of 100 characters."""
    return spark.range(rows).select(F.col("id").alias("user_id"), *[F.rpad(_text(seed + k, 64, "id"), 100, "x").alias(f"file_{k}") for k in range(10)])


def key_value_operations(
    spark: SparkSession, transactions: int, rows: int = 100_000, theta: float = 0.95, read_percent: int = 50, size: int = 10, seed: int = 11,
    *, hot_keys: int | None = None, hot_percent: int = 80, nodes: int = 1, local_percent: int = 0, writers: int | None = None,
) -> DataFrame:
    """(txn_id, op_seq, node, item_key, is_write): `size` operations in a transaction, transactions dealt out to nodes in turn.

    Keys are Zipf-distributed; with hot_keys, hot_percent of the operations take one of the first so many keys, the rest any
    other, each evenly. local_percent of the operations then take a key of the node's own range of keys, at the same place in it.
    writers: exactly the first so many operations of a transaction write, instead of a share by read_percent.
    """
    at = ("txn_id", "op_seq")
    ops = _grid(spark, {"txn_id": transactions, "op_seq": size}).withColumn("node", (F.col("txn_id") % nodes).cast("int"))
    if hot_keys is None:
        key = rules.zipf_rank(_draw(seed, *at), rows, theta)
    else:
        key = F.when(_draw(seed + 2, *at) * 100 < hot_percent, _pick(seed, 0, hot_keys - 1, *at)).otherwise(_pick(seed, hot_keys, rows - 1, *at))
    span = -(-rows // nodes)
    own = F.least(F.col("node") * span + key % span, F.lit(rows - 1))
    key = F.when(_draw(seed + 3, *at) * 100 < local_percent, own).otherwise(key).cast("bigint")
    writes = F.col("op_seq") < writers if writers is not None else _draw(seed + 1, *at) * 100 >= read_percent
    return ops.select(*at, "node", key.alias("item_key"), writes.alias("is_write"))


# The bank's transactions and their shares in percent.
BANK_MIX = {"amalgamate": 20, "balance": 5, "deposit_checking": 15, "send_payment": 20, "transact_saving": 20, "write_check": 20}


def bank_operations(spark: SparkSession, transactions: int, accounts: int = 300_000, mix: dict[str, int] | None = None, hot_accounts: int = 0, hot_percent: int = 0, size: int = 1, seed: int = 17) -> DataFrame:
    """(txn_id, op_seq, kind, source, target, amount): kinds by their shares; source and target differ, hot_percent of both among the
    first accounts. size: operations of a transaction, all of its kind (a long transaction has several)."""
    mix, left, kind = mix or BANK_MIX, 0.0, None
    draw, total = _draw(seed, "txn_id"), sum((mix or BANK_MIX).values())
    for name, share in mix.items():
        left += share / total
        kind = F.when(draw < left, name) if kind is None else kind.when(draw < left, name)
    kind = kind.otherwise(name)

    def account(salt: int) -> Column:
        wide = _pick(salt, 0, accounts - 1, *at)
        return F.when(_draw(salt + 1, *at) * 100 < hot_percent, _pick(salt, 0, hot_accounts - 1, *at)).otherwise(wide) if hot_accounts else wide

    at = ("txn_id", "op_seq")
    ops = _grid(spark, {"txn_id": transactions, "op_seq": size}).select(*at, kind.alias("kind"), account(seed + 1).alias("source"), account(seed + 3).alias("_t"), _pick(seed + 5, 1, 100, *at).cast("int").alias("amount"))
    target = F.when(F.col("_t") == F.col("source"), (F.col("source") + 1) % accounts).otherwise(F.col("_t"))
    return ops.select(*at, "kind", "source", target.cast("bigint").alias("target"), "amount")


def verified(children: DataFrame, parents: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Rows of children without a parent: empty for tables that were loaded whole."""
    return children.join(parents.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key)]), child_key, "left_anti")
