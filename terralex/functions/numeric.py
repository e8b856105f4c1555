"""Number parsing, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex.functions.text import trim_to_null


def round_half_up(value: Column, digits: int = 12) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which differs from half-away-from-zero for negatives."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def safe_divide(numerator: Column, denominator: Column) -> Column:
    ratio = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return F.coalesce(ratio, F.lit(0.0))


def finite(value: Column) -> Column:
    """True only for real numbers: null, NaN and infinities are false."""
    as_double = value.cast("double")
    return F.coalesce(~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf"))), F.lit(False))


def parse_number(text: Column) -> Column:
    return trim_to_null(text).try_cast("double")


def number_error(text: Column, field: str, integer: bool = False, low: float | None = None,
                 high: float | None = None) -> Column:
    """Null when the text is blank or a number in range, else the message."""
    value = parse_number(text)
    ok = finite(value)
    if integer:
        ok = ok & (value == F.floor(value))
    if low is not None:
        ok = ok & (value >= F.lit(float(low)))
    if high is not None:
        ok = ok & (value <= F.lit(float(high)))
    return F.when(trim_to_null(text).isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(f"{field} is invalid"))
