"""Exact money.

Prices and discounts have two decimals, so the revenue of a line, ``price * (1 - discount)``,
is a whole number of ten-thousandths.  Lines are computed and summed in that unit as BIGINT,
which stays in code-generated long arithmetic (about twice the speed of DECIMAL(38,4) sums),
and become DECIMAL(38,4) only after aggregation.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

EXACT = "decimal(38,4)"
_UNIT = Decimal("0.0001")
# Sums keep the low 30 bits and the rest apart: neither BIGINT overflows, even when one order
# owns hundreds of billions of lines, which a plain BIGINT sum would not survive.
_LOW_BITS = 30


def cents(column: str) -> Column:
    """An amount (DOUBLE or DECIMAL) as whole cents, rounded as DECIMAL(15,2) is: half away from
    zero in decimal digits.  Amounts that have two decimals, nearly all, need no such rounding."""

    def whole(amount: Column) -> Column:
        return F.rint(amount.cast("double") * 100)

    plain = F.col(column).cast("double") * 100
    exact = whole(F.col(column).cast("decimal(15,2)"))
    return F.when(F.abs(plain - F.rint(plain)) < 0.001, F.rint(plain)).otherwise(exact).cast("bigint")


def line_units(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """``price * (1 - discount)`` in ten-thousandths."""
    return cents(price) * (F.lit(100) - cents(discount))


def units_to_amount(units: Column) -> Column:
    return (units.cast("decimal(38,0)") * F.lit(_UNIT)).cast(EXACT)


def sum_units(units: Column) -> Column:
    """Aggregate: exact sum of ten-thousandths as DECIMAL(38,4)."""
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(38,0)")
    return units_to_amount(high * F.lit(1 << _LOW_BITS) + low)


def sum_cents(column: str) -> Column:
    """Aggregate: exact sum of a two-decimal column as DECIMAL(38,4)."""
    return sum_units(cents(column) * 100)


def line_revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """``price * (1 - discount)`` of one line as DECIMAL(38,4)."""
    return units_to_amount(line_units(price, discount))


def to_cents(column: str | Column) -> Column:
    """Rounded to two decimals, half away from zero."""
    return F.round(column, 2).cast(EXACT)


def round_units(units: Column) -> Column:
    """Ten-thousandths rounded to whole cents (multiples of 100), half away from zero."""

    def half_up(value: Column) -> Column:
        return value + 50 - (value + 50) % 100

    return F.when(units >= 0, half_up(units)).otherwise(-half_up(-units))
