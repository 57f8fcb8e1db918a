"""Text forms of values and results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 16


def char_value(c: Column, size: int) -> Column:
    """A string as CHAR(size) stores it: cut to `size` bytes, ended by the first NUL."""
    cut = F.decode(F.substring(F.encode(c, "UTF-8"), 1, size), "UTF-8")
    return F.substring_index(cut, "\0", 1)


def char_bytes(value: str, size: int) -> str:
    """The same for a literal; a character that the cut would split goes as a whole."""
    return value.encode()[:size].decode(errors="ignore").split("\0")[0]


def float_text(c: Column) -> Column:
    return F.format_string("%.6f", c.cast("double"))


def cell(c: Column) -> Column:
    """A cell of a printed table: over 16 characters, the first 13 and three dots; right-aligned."""
    return F.lpad(F.when(F.length(c) > CELL, F.concat(F.substring(c, 1, CELL - 3), F.lit("..."))).otherwise(c), CELL, " ")


def table_lines(names: Sequence[str], rows: Iterable[Sequence[object]]) -> Iterator[str]:
    """Lines of a printed result: ruled columns of 16, and the number of records; one row is held at a time."""

    def text(v: object) -> str:
        s = f"{v:.6f}" if isinstance(v, float) else str(v)
        return (s[: CELL - 3] + "..." if len(s) > CELL else s).rjust(CELL)

    rule = "+" + "+".join("-" * (CELL + 2) for _ in names) + "+"
    line = lambda values: "|" + "|".join(f" {text(v)} " for v in values) + "|"
    yield from (rule, line(names), rule)
    n = 0
    for row in rows:
        n += 1
        yield line(row)
    yield from (rule, f"Total record(s): {n}", "")
