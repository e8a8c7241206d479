"""Numeric scalar functions (F4-F7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, guard_digits: int = 6) -> Column:
    """Half-to-even rounding to an integer.

    The value is first rounded to ``guard_digits`` decimals so that the order
    in which fractions were summed cannot turn an exact half into 0.4999...
    """
    return F.bround(F.round(_c(c).cast("double"), guard_digits), 0).cast("int")


def sign_net(c) -> Column:
    """1 / 0 / -1 migration code from a signed difference."""
    return F.signum(_c(c)).cast("int")


def sign_net2(c) -> Column:
    """F6, two-valued form: 1 if positive else 0."""
    return F.when(_c(c) > 0, F.lit(1)).otherwise(F.lit(0))


def calc_points(p20, p10, net) -> Column:
    """points to draw for a block: P20, plus P10 for a losing block."""
    return F.when(_c(net) < 0, _c(p20) + _c(p10)).otherwise(_c(p20))


def hsum(cols) -> Column:
    """Row-wise sum of several columns."""
    cols = [_c(c) for c in cols]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def hsum_abs(cols) -> Column:
    """Row-wise sum of absolute values."""
    return hsum([F.abs(_c(c)) for c in cols])
