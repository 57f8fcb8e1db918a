"""Update rules of the workloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syllables of generated last names.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
OVERDRAFT_AMOUNT = 5
HISTORY_CHARS = 500


def restocked(quantity: Column, ordered: Column) -> Column:
    """Stock after an order: below ten left it is filled up by 91."""
    left = quantity - ordered
    return F.when(left >= 10, left).otherwise(left + 91)


def bad_credit_data(c: Column, c_d: Column, c_w: Column, d: Column, w: Column, amount: Column, data: Column) -> Column:
    """A payment's note before the customer's data, cut to the field's size."""
    return F.substring(F.concat(F.format_string("(%d, %d, %d, %d, %d, %.2f)\n", c, c_d, c_w, d, w, amount.cast("double")), data), 1, HISTORY_CHARS)


def history_text(warehouse: Column, district: Column) -> Column:
    return F.concat_ws("    ", warehouse, district)


def checked_balance(savings: Column, checking: Column, amount: Column | int = OVERDRAFT_AMOUNT) -> Column:
    """Checking balance after a cheque: one more is taken if both balances together don't cover it."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return checking - F.when(savings + checking < amount, amount + 1).otherwise(amount)


def debited(balance: Column, amount: Column | int = OVERDRAFT_AMOUNT) -> Column:
    """A payment's source balance: unchanged where it doesn't cover the amount."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return F.when(balance >= amount, balance - amount).otherwise(balance)


def last_name(number: Column) -> Column:
    """The name of a number from 0 to 999: a syllable for each digit."""
    names = F.array(*map(F.lit, SYLLABLES))
    digit = lambda by: F.element_at(names, (F.floor(number / by) % 10 + 1).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def hot_key_count(n: Column, theta: Column, mass: Column) -> Column:
    """The fewest leading keys of a Zipf distribution over n keys that get at least `mass` of the accesses, approximately:
    ceil(n * mass ** (1 / (1 - theta))), within [1, n]; 0 without skew or mass, n for the whole mass, 1 from theta = 1 on."""
    k = F.ceil(n * F.pow(mass, 1 / (1 - theta)))
    inner = F.greatest(F.lit(1).cast("bigint"), F.least(k.cast("bigint"), n.cast("bigint")))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return F.when((n == 0) | (mass <= 0), zero).when(mass >= 1, n.cast("bigint")).when(theta <= 0, zero).when(theta >= 1, one).otherwise(inner)


def zipf_rank(u: Column, n: int, theta: float) -> Column:
    """A rank from 0 to n - 1 from a uniform variate, by the closed form for fast Zipf sampling (Gray et al., 1994).

    The normalising sum takes n terms once, on the driver, for n up to a million; beyond that its tail is an integral.
    """
    head = min(n, 1_000_000)
    zeta = sum(i**-theta for i in range(1, head + 1))
    if n > head:
        zeta += ((n + 0.5) ** (1 - theta) - (head + 0.5) ** (1 - theta)) / (1 - theta)
    two = 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - two / zeta)
    far = F.floor(n * F.pow(eta * (u - 1) + 1, F.lit(1 / (1 - theta))))
    uz = u * zeta
    return F.when(uz < 1, 0).when(uz < two, 1).otherwise(F.least(far, F.lit(n - 1))).cast("bigint")
