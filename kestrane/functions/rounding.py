"""Rounding of binary fractions as they are, not as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^27 + 1 halves a double's 53 bits; from 2^52 on doubles are whole.
_HALVES, _WHOLE = 134217729.0, 4503599627370496.0


def _halves(x: Column | float) -> tuple:
    """Two doubles of 26 bits whose sum is x."""
    c = x * _HALVES
    high = c - (c - x)
    return high, x - high


def half_even(x: Column, digits: int) -> Column:
    """x rounded to so many digits (0 to 22), ties to the even one, by the exact value of the double.

    2.675 is a little less than it is shown as, and becomes 2.67; 0.125 is a tie, and becomes
    0.12. The product with the power of ten is kept exactly, as its double and what that lost, so
    no decimal text is made. Null, NaN and infinite values stay; there is no minus zero.
    """
    scale = float(10**digits)
    size = F.abs(x.cast("double"))
    product = size * scale
    (high, low), (scale_high, scale_low) = _halves(size), _halves(scale)
    lost = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + lost  # its sign is exact
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    signed = F.when(x < 0, -rounded).otherwise(rounded) + F.lit(0.0)
    return F.when(F.isnan(x) | (product >= _WHOLE), x.cast("double")).otherwise(signed)
