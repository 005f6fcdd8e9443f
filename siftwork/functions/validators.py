"""Checksums of identity numbers as Column expressions; null gives false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import digits_only

#: Weights of the check digits (fixed values).
INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
SNILS = [9, 8, 7, 6, 5, 4, 3, 2, 1]


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the first len(weights) digits times their weights."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.coalesce(F.try_to_number(F.substring(digits, k + 1, 1), F.lit("9")).cast("int"), F.lit(0)) * w
    return total


def _digit(digits: Column, at: int, n: int = 1) -> Column:
    return F.coalesce(F.try_to_number(F.substring(digits, at, n), F.lit("9" * n)).cast("int"), F.lit(-1))


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def card_ok(c: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    d = digits_only(c)
    return _known(F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def snils_ok(c: Column) -> Column:
    """11 digits, not all zero; the last two are the weighted sum modulo 101 (100 as 0)."""
    d = digits_only(c)
    r = _weighted(d, SNILS) % 101
    return _known((F.length(d) == 11) & (d != "00000000000") & (F.when(r == 100, 0).otherwise(r) == _digit(d, 10, 2)))


def inn_ok(c: Column) -> Column:
    """10 or 12 digits with right check digits."""
    d = digits_only(c)
    ten = (F.length(d) == 10) & (_weighted(d, INN_10) % 11 % 10 == _digit(d, 10))
    twelve = (F.length(d) == 12) & (_weighted(d, INN_11) % 11 % 10 == _digit(d, 11)) & (_weighted(d, INN_12) % 11 % 10 == _digit(d, 12))
    return _known(ten | twelve)


def passport_ok(series: Column, number: Column) -> Column:
    """Four digits whose first two are a region from 1, and six digits that aren't all zero."""
    s, n = digits_only(series), digits_only(number)
    return _known((F.length(s) == 4) & (F.length(n) == 6) & (F.substring(s, 1, 2) != "00") & (n != "000000"))


def mrz_digit_ok(field: Column, check: Column) -> Column:
    """Weights 7, 3, 1 over figures, letters from A = 10 and fillers; any other character fails."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = F.transform(F.filter(F.split(F.upper(field), ""), lambda x: x != ""), lambda x: F.when(x == "<", 0).otherwise(F.instr(F.lit(alphabet), x) - 1))
    weighted = F.transform(values, lambda v, i: v * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, v: a + v)
    return _known(F.forall(values, lambda v: v >= 0) & check.rlike("^[0-9]$") & ((total % 10).cast("string") == check))


def valid(pattern: Column, raw: Column) -> Column:
    """The check that goes with a pattern; others are always valid."""
    d = digits_only(raw)
    ten = F.substring(d, 1, 10)
    return (
        F.when(pattern == "card_number", card_ok(raw))
        .when(pattern == "snils", snils_ok(raw))
        .when(pattern.isin("inn", "inn_context"), inn_ok(raw))
        .when(pattern == "passport_rf", (F.length(d) >= 10) & passport_ok(F.substring(ten, 1, 4), F.substring(ten, 5, 6)))
        .otherwise(F.lit(True))
    )
