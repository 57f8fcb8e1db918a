"""Transaction bodies of the order-entry and bank workloads as set-oriented pipelines: what to read is a join, what to write a new image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import rules


def new_order(orders: DataFrame, lines: DataFrame, district: DataFrame, stock: DataFrame) -> dict[str, DataFrame]:
    """orders: (w, d, c, seq), lines: (w, d, seq, number, i, supply_w, quantity), of one batch.

    Order ids go on from the district's next one in order of seq; returns the new rows of orders, new_orders and
    order_line, and the new images of district and stock. Lines of one item in a batch fill up its stock line by line.
    """
    numbered = orders.withColumn("_n", F.row_number().over(Window.partitionBy("w", "d").orderBy("seq")))
    start = district.select(F.col("d_w_id").alias("w"), F.col("d_id").alias("d"), "d_next_o_id")
    placed = numbered.join(start, ["w", "d"]).withColumn("o_id", (F.col("d_next_o_id") + F.col("_n") - 1).cast("int"))
    counts = lines.groupBy("w", "d", "seq").agg(F.count("*").cast("int").alias("o_ol_cnt"), F.min((F.col("supply_w") == F.col("w")).cast("int")).alias("o_all_local"))
    made = placed.join(counts, ["w", "d", "seq"])
    new_lines = lines.join(placed.select("w", "d", "seq", "o_id"), ["w", "d", "seq"])
    taken = placed.groupBy(F.col("w").alias("d_w_id"), F.col("d").alias("d_id")).agg(F.count("*").alias("_k"))
    district2 = district.join(taken, ["d_w_id", "d_id"], "left").withColumn("d_next_o_id", (F.col("d_next_o_id") + F.coalesce("_k", F.lit(0))).cast("int")).select(district.columns)
    demand = lines.groupBy(F.col("supply_w").alias("s_w_id"), F.col("i").alias("s_i_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "d", "number", "quantity"))), lambda x: x["quantity"]).alias("_q"),
        F.sum((F.col("supply_w") != F.col("w")).cast("int")).cast("int").alias("_r"),
    )
    left = F.aggregate("_q", F.col("s_quantity"), lambda s, q: rules.restocked(s, q).cast("int"))
    q = F.coalesce("_q", F.expr("cast(array() as array<int>)"))
    stock2 = stock.join(demand, ["s_w_id", "s_i_id"], "left").withColumn("_q", q).select(
        *[{"s_quantity": left, "s_ytd": F.col("s_ytd") + F.aggregate("_q", F.lit(0), lambda s, x: (s + x).cast("int")), "s_order_cnt": F.col("s_order_cnt") + F.size("_q"), "s_remote_cnt": F.col("s_remote_cnt") + F.coalesce("_r", F.lit(0))}.get(c, F.col(c)).alias(c) for c in stock.columns]
    )
    return {
        "orders": made.select(F.col("w").alias("o_w_id"), F.col("d").alias("o_d_id"), "o_id", F.col("c").alias("o_c_id"), F.lit(0).alias("o_carrier_id"), "o_ol_cnt", "o_all_local"),
        "new_orders": placed.select(F.col("o_id").alias("no_o_id"), F.col("d").alias("no_d_id"), F.col("w").alias("no_w_id")),
        "order_line": new_lines.select(F.col("w").alias("ol_w_id"), F.col("d").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"), F.col("number").alias("ol_number"), F.col("i").alias("ol_i_id"), F.col("supply_w").alias("ol_supply_w_id"), F.col("quantity").alias("ol_quantity")),
        "district": district2,
        "stock": stock2,
    }


def payment(payments: DataFrame, customer: DataFrame, warehouse: DataFrame, district: DataFrame) -> dict[str, DataFrame]:
    """payments: (w, d, c_w, c_d, c, amount, seq) of one batch; new images of customer, warehouse and district, and history rows.

    Notes of bad-credit customers are put before their data in order of seq.
    """
    k = ["c_w_id", "c_d_id", "c_id"]
    one = payments.select(F.col("c_w").alias("c_w_id"), F.col("c_d").alias("c_d_id"), F.col("c").alias("c_id"), "w", "d", "amount", "seq")
    paid = one.groupBy(*k).agg(F.sum("amount").alias("_sum"), F.count("*").cast("int").alias("_n"), F.array_sort(F.collect_list(F.struct("seq", "d", "w", "amount"))).alias("_p"))
    noted = F.aggregate("_p", F.col("c_data"), lambda s, x: rules.bad_credit_data(F.col("c_id"), F.col("c_d_id"), F.col("c_w_id"), x["d"], x["w"], x["amount"], s))
    new = {"c_balance": F.col("c_balance") - F.col("_sum"), "c_ytd_payment": F.col("c_ytd_payment") + F.col("_sum"), "c_payment_cnt": F.col("c_payment_cnt") + F.col("_n"), "c_data": F.when(F.col("c_credit") == "BC", noted).otherwise(F.col("c_data"))}
    customer2 = customer.join(paid, k, "left").select(*[F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in customer.columns])
    to_w = payments.groupBy(F.col("w").alias("w_id")).agg(F.sum("amount").alias("_s"))
    to_d = payments.groupBy(F.col("w").alias("d_w_id"), F.col("d").alias("d_id")).agg(F.sum("amount").alias("_s"))
    warehouse2 = warehouse.join(to_w, "w_id", "left").withColumn("w_ytd", F.col("w_ytd") + F.coalesce("_s", F.lit(0.0))).select(warehouse.columns)
    district2 = district.join(to_d, ["d_w_id", "d_id"], "left").withColumn("d_ytd", F.col("d_ytd") + F.coalesce("_s", F.lit(0.0))).select(district.columns)
    names = payments.join(warehouse.select(F.col("w_id").alias("w"), "w_name"), "w").join(district.select(F.col("d_w_id").alias("w"), F.col("d_id").alias("d"), "d_name"), ["w", "d"])
    history = names.select(F.col("c").alias("h_c_id"), F.col("c_d").alias("h_c_d_id"), F.col("c_w").alias("h_c_w_id"), F.col("d").alias("h_d_id"), F.col("w").alias("h_w_id"), F.col("amount").alias("h_amount"), rules.history_text(F.col("w_name"), F.col("d_name")).alias("h_data"))
    return {"customer": customer2, "warehouse": warehouse2, "district": district2, "history": history}


def customer_by_name(customer: DataFrame) -> DataFrame:
    """Of each (warehouse, district, last name) the customer at position ceil(n / 2) by first name."""
    from lakeloom.operators.windows import position_in_group

    return position_in_group(customer, ["c_w_id", "c_d_id", "c_last"], ["c_first", "c_id"], 1, 2)


def delivery(new_orders: DataFrame, orders: DataFrame, lines: DataFrame, customer: DataFrame, carrier: int) -> dict[str, DataFrame]:
    """The oldest new order of each district is delivered: new images of new_orders, orders and customer."""
    oldest = new_orders.groupBy(F.col("no_w_id").alias("o_w_id"), F.col("no_d_id").alias("o_d_id")).agg(F.min("no_o_id").alias("o_id"))
    k = ["o_w_id", "o_d_id", "o_id"]
    rest = new_orders.join(oldest.toDF("no_w_id", "no_d_id", "no_o_id"), ["no_w_id", "no_d_id", "no_o_id"], "left_anti").select(new_orders.columns)
    orders2 = orders.join(oldest.withColumn("_hit", F.lit(True)), k, "left").withColumn("o_carrier_id", F.when(F.col("_hit"), F.lit(carrier)).otherwise(F.col("o_carrier_id"))).select(orders.columns)
    amounts = lines.select(F.col("ol_w_id").alias("o_w_id"), F.col("ol_d_id").alias("o_d_id"), F.col("ol_o_id").alias("o_id"), "ol_amount").join(oldest, k).groupBy(*k).agg(F.sum("ol_amount").alias("_sum"))
    owed = amounts.join(orders.select(*k, "o_c_id"), k).select(F.col("o_w_id").alias("c_w_id"), F.col("o_d_id").alias("c_d_id"), F.col("o_c_id").alias("c_id"), "_sum")
    customer2 = customer.join(owed, ["c_w_id", "c_d_id", "c_id"], "left").withColumn("c_balance", F.col("c_balance") + F.coalesce("_sum", F.lit(0.0))).withColumn("c_delivery_cnt", F.col("c_delivery_cnt") + F.col("_sum").isNotNull().cast("int")).select(customer.columns)
    return {"new_orders": rest, "orders": orders2, "customer": customer2}


def order_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each customer's latest order."""
    last = orders.groupBy("o_w_id", "o_d_id", "o_c_id").agg(F.max("o_id").alias("o_id"))
    on = (lines["ol_w_id"] == last["o_w_id"]) & (lines["ol_d_id"] == last["o_d_id"]) & (lines["ol_o_id"] == last["o_id"])
    return last.join(lines, on).select("o_w_id", "o_d_id", "o_c_id", "o_id", "ol_number", "ol_i_id", "ol_quantity", "ol_amount")


def stock_level(lines: DataFrame, district: DataFrame, stock: DataFrame, threshold: int, last: int = 20) -> DataFrame:
    """(w, d, low_stock): distinct items of each district's last orders whose stock is below the threshold."""
    recent = lines.join(district.select(F.col("d_w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"), "d_next_o_id"), ["ol_w_id", "ol_d_id"]).where((F.col("ol_o_id") < F.col("d_next_o_id")) & (F.col("ol_o_id") >= F.col("d_next_o_id") - last))
    low = stock.where(F.col("s_quantity") < threshold).select(F.col("s_w_id").alias("ol_w_id"), F.col("s_i_id").alias("ol_i_id"))
    return recent.join(low, ["ol_w_id", "ol_i_id"]).groupBy(F.col("ol_w_id").alias("w"), F.col("ol_d_id").alias("d")).agg(F.countDistinct("ol_i_id").alias("low_stock"))


def _moved(accounts: DataFrame, change: DataFrame) -> DataFrame:
    total = change.groupBy("acct_id").agg(F.sum("delta").alias("_d"))
    return accounts.join(total, "acct_id", "left").withColumn("bal", F.col("bal") + F.coalesce("_d", F.lit(0.0))).select(accounts.columns)


def amalgamate(savings: DataFrame, checking: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All money of `source` goes to the checking account of `target`; a source is in one pair."""
    s = pairs.join(savings.select(F.col("acct_id").alias("source"), F.col("bal").alias("s")), "source").join(checking.select(F.col("acct_id").alias("source"), F.col("bal").alias("c")), "source")
    out_s = s.select(F.col("source").alias("acct_id"), (-F.col("s")).alias("delta"))
    out_c = s.select(F.col("source").alias("acct_id"), (-F.col("c")).alias("delta")).union(s.select(F.col("target").alias("acct_id"), (F.col("s") + F.col("c")).alias("delta")))
    return _moved(savings, out_s), _moved(checking, out_c)


def send_payment(checking: DataFrame, pairs: DataFrame, amount: int = rules.OVERDRAFT_AMOUNT) -> DataFrame:
    """Each source that can pays `amount` to its target; a source is in one pair."""
    able = pairs.join(checking.where(F.col("bal") >= amount).select(F.col("acct_id").alias("source")), "source")
    moves = able.select(F.col("source").alias("acct_id"), F.lit(-float(amount)).alias("delta")).union(able.select(F.col("target").alias("acct_id"), F.lit(float(amount)).alias("delta")))
    return _moved(checking, moves)


def deposit(accounts: DataFrame, deposits: DataFrame) -> DataFrame:
    """deposits (acct_id, amount) are added: deposits to checking, transactions on savings."""
    return _moved(accounts, deposits.select("acct_id", F.col("amount").cast("double").alias("delta")))


def balances(savings: DataFrame, checking: DataFrame) -> DataFrame:
    return savings.withColumnRenamed("bal", "s").join(checking.withColumnRenamed("bal", "c"), "acct_id").select("acct_id", (F.col("s") + F.col("c")).alias("total"))


def write_check(savings: DataFrame, checking: DataFrame, cheques: DataFrame) -> DataFrame:
    """New checking accounts after one cheque for each acct_id of cheques (acct_id, amount)."""
    both = checking.join(savings.withColumnRenamed("bal", "_s"), "acct_id").join(cheques, "acct_id", "left")
    return both.withColumn("bal", F.when(F.col("amount").isNotNull(), rules.checked_balance(F.col("_s"), F.col("bal"), F.col("amount"))).otherwise(F.col("bal"))).select(checking.columns)
