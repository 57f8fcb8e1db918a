"""Composite keys of the order-entry schema, as long integers; operands are widened first, so nothing overflows in 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key layout.
DISTRICTS, CUSTOMERS, STOCK, MAX_ORDERS, MAX_LINES = 10, 3000, 100_000, 10_000_000, 15


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _packed(high: Column, low: Column, bits: int = 32) -> Column:
    return F.shiftleft(_long(high), bits).bitwiseOR(_long(low))


def district_key(w: Column, d: Column, districts: int = DISTRICTS) -> Column:
    return _long(w) * districts + _long(d)


def customer_key(w: Column, d: Column, c: Column, districts: int = DISTRICTS) -> Column:
    return _packed(district_key(w, d, districts), c)


def order_key(w: Column, d: Column, o: Column, districts: int = DISTRICTS) -> Column:
    """Also the key of a new order."""
    return _packed(district_key(w, d, districts), o)


def order_index_key(w: Column, d: Column, c: Column, o: Column, districts: int = DISTRICTS, customers: int = CUSTOMERS) -> Column:
    return _packed(district_key(w, d, districts) * customers + _long(c), o)


def history_key(w: Column, d: Column, c_w: Column, c_d: Column, c: Column, districts: int = DISTRICTS, customers: int = CUSTOMERS) -> Column:
    return _packed(district_key(c_w, c_d, districts) * customers + _long(c), district_key(w, d, districts), 20)


def order_line_key(w: Column, d: Column, o: Column, number: Column, districts: int = DISTRICTS) -> Column:
    return (district_key(w, d, districts) * MAX_ORDERS + _long(o)) * MAX_LINES + _long(number)


def stock_key(w: Column, i: Column, stock: int = STOCK) -> Column:
    return _long(i) + _long(w) * stock


def owner_node(page: Column, partition_size: int, nodes: int) -> Column:
    """The node that owns a page (from 1 on) when runs of pages are dealt out in turn."""
    return F.pmod(F.floor((_long(page) - 1) / partition_size), F.lit(nodes)).cast("int")


def lock_key(table: Column, key: Column) -> Column:
    """A 64-bit hash that names a row's lock."""
    return F.xxhash64(table, _long(key))
