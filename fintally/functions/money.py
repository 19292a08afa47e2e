"""Exact money: cents are LONG, products DECIMAL(38,0), quotients half-even. No DOUBLE anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def half_even(n: Column, d: Column) -> Column:
    """n / d rounded half to even, exactly; an error where d is zero."""
    n, d = n.cast(BIG), d.cast(BIG)
    size, unit = F.abs(n), F.abs(d)
    rest = size % unit
    whole = ((size - rest) / unit).cast(BIG)
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    out = whole + F.when(up, 1).otherwise(0).cast(BIG)
    signed = F.when((n < 0) != (d < 0), -out).otherwise(out).cast(BIG)
    return F.when(d == 0, F.raise_error(F.lit("division by zero"))).otherwise(signed)


def times_ratio(cents: Column, n: Column, d: Column) -> Column:
    return half_even(cents.cast(BIG) * n.cast(BIG), d).cast("long")


def decimal_ratio(n: Column, d: Column, scale: int) -> Column:
    """The mantissa of n / d at a scale."""
    return half_even(n.cast(BIG) * F.lit(10**scale).cast(BIG), d).cast("long")


def rescale(mantissa: Column, scale: Column, target: int) -> Column:
    """A mantissa at another scale: exact upwards, half-even downwards (scales up to 18)."""
    power = lambda k: F.pow(F.lit(10), k).cast(BIG)  # noqa: E731  exact up to 10^22
    up = mantissa.cast(BIG) * power(F.greatest(F.lit(target) - scale, F.lit(0)))
    return half_even(up, power(F.greatest(scale - F.lit(target), F.lit(0)))).cast("long")


def dollars(cents: Column) -> Column:
    """-$1,234.56 of cents, by integer arithmetic."""
    size = F.abs(cents.cast(BIG))
    whole = ((size - size % 100) / 100).cast(BIG).cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), grouped, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def from_double(amount: Column) -> Column:
    """Cents of a DOUBLE column that holds two decimals; the one place where such a column enters."""
    return (amount.cast("decimal(18,2)") * 100).cast("long")
