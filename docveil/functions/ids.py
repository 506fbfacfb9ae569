"""National identity numbers and other checked numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the two checks.
CPR_WEIGHTS = (4, 3, 2, 7, 6, 5, 4, 3, 2, 1)
CVR_WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 1)


def _all_digits(digits: Column, n: int) -> Column:
    return digits.rlike(f"^[0-9]{{{n}}}$")


def _digit(digits: Column, k: int) -> Column:
    return F.substring(digits, k, 1).try_cast("int")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights, 1):
        total = total + w * _digit(digits, k)
    return F.when(_all_digits(digits, len(weights)), total % 11 == 0).otherwise(F.lit(False))


def cpr_mod11(digits: Column) -> Column:
    return _weighted(digits, CPR_WEIGHTS)


def cvr_mod11(digits: Column) -> Column:
    return _weighted(digits, CVR_WEIGHTS)


def cpr_century(seventh: Column, yy: Column) -> Column:
    """1800, 1900 or 2000, by the seventh digit and the two of the year."""
    return (
        F.when(seventh <= 3, 1900)
        .when(seventh.isin(4, 9), F.when(yy <= 36, 2000).otherwise(1900))
        .otherwise(F.when(yy <= 57, 2000).otherwise(1800))
    )


def cpr_birth_date(digits: Column) -> Column:
    """The date in the first six of ten digits; null if it is none. A day above 31 has 60 added."""
    day, yy = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 5, 2).try_cast("int")
    day = F.when(day > 31, day - 60).otherwise(day)
    year = cpr_century(_digit(digits, 7), yy) + yy
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(_all_digits(digits, 10) & (day > 0), F.try_to_date(text, "yyyy-MM-dd"))


def luhn(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def iban_ok(value: Column) -> Column:
    """Modulo 97 of the account number, reduced digit by digit."""
    plain = F.regexp_replace(F.upper(value), r"\s", "")
    turned = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        v = F.when(n >= 65, n - 55).otherwise(n - 48)
        return ((acc * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")

    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), F.aggregate(chars, F.lit(0), step) == 1).otherwise(F.lit(False))
