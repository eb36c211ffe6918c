"""Scalar expressions with the null, zero and infinity rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Added to denominators so that a zero never divides.
EPS = 1e-9

# Distance of the rounding tie point from the lattice, in units of the last digit kept.
CANON_SHIFT = 3.7e-4


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound x; NULL stays NULL (greatest/least alone would turn it into a bound)."""
    y = x
    if low is not None:
        y = F.greatest(y, lit(low))
    if high is not None:
        y = F.least(y, lit(high))
    return F.when(x.isNotNull(), y)


def fill(x: Column, value: float) -> Column:
    return F.coalesce(x, lit(value))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.when(b != 0, b)


def div_ieee(a: Column, b: Column) -> Column:
    """a / b with x/0 as signed infinity and 0/0 as NULL."""
    return (
        F.when(b != 0, a / F.when(b != 0, b))
        .when((b == 0) & (a > 0), F.lit(float("inf")))
        .when((b == 0) & (a < 0), F.lit(float("-inf")))
    )


def finite(x: Column) -> Column:
    """x, NULL where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    """a / (b + EPS)."""
    return a / (b + lit(EPS))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def canon(x: Column, digits: int = 6) -> Column:
    """Round for comparison across engines.

    The tie point is moved slightly off the decimal lattice, so that averages of
    decimal inputs, which often sit exactly on a tie, round alike wherever they
    are computed; adding 0.0 turns a negative zero into zero.
    """
    scale = lit(10.0**digits)
    return F.rint(x * scale + lit(CANON_SHIFT)) / scale + lit(0.0)
