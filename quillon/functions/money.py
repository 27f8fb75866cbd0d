"""Money columns, kept exact."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to here are exact as doubles.
EXACT = float(2**53)
#: The results are decimals of 18 digits.
LIMIT = 1e18


def net_units(price: Column, discount: Column) -> Column:
    """Price less discount in hundredths of a cent, as a whole number.

    Prices are whole cents and discounts whole percent, held as doubles. A sum of
    doubles depends on the order of addition, which changes with the partitioning
    and with every retried task; whole numbers add up to the same value in any
    order. They are counted as longs per row, which costs a third of casting each
    double to a decimal, and summed as decimals, which a large table cannot
    overflow as it could a long.

    Null if either is null. Raises, whatever the ANSI setting, on a price that is not
    whole cents, a discount that is not whole percent, either beyond what a double
    holds exactly, infinite or not a number, and on a result of more than 18 digits.
    """
    cents, percent = price * 100, discount * 100
    units = F.rint(cents) * (100 - F.rint(percent))
    fits = _whole(cents) & _whole(percent) & (F.abs(units) < LIMIT)
    exact = F.rint(cents).cast("bigint") * (F.lit(100) - F.rint(percent).cast("bigint"))
    refusal = F.concat(
        F.lit("not whole cents and whole percent, or too large: price "),
        price.cast("string"),
        F.lit(", discount "),
        discount.cast("string"),
    )
    return (
        F.when(price.isNull() | discount.isNull(), F.lit(None).cast("decimal(18,0)"))
        .when(~fits, F.raise_error(refusal).cast("decimal(18,0)"))
        .otherwise(exact.cast("decimal(18,0)"))
    )


def _whole(value: Column) -> Column:
    """Whether a double is a whole number, but for the noise of a product of doubles.

    Infinity and NaN, which Spark orders last, are beyond the bound.
    """
    noise = F.greatest(F.lit(1e-6), F.abs(value) * 2.0**-52)
    return (F.abs(value) <= EXACT) & (F.abs(value - F.rint(value)) <= noise)


def units_to_money(units: Column) -> Column:
    """Hundredths of a cent, as `net_units` counts them, as a decimal amount."""
    return units * F.lit(Decimal("0.0001"))
