"""Null handling and numeric coercion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    """NaN and the infinities become NULL, the only missing value used here."""
    c = _col(c).cast("double")
    return F.when(is_finite(c), c)


def coerce_number(c: Column | str, fill: float | None = 0.0) -> Column:
    """Text to double; what does not parse, or is no number (NaN), becomes ``fill``."""
    number = F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def impute_constant(
    c: Column | str, missing: float = 0.0, posinf: float | None = None, neginf: float | None = None
) -> Column:
    """NULL/NaN to ``missing``; the infinities to their own replacement."""
    c = _col(c).cast("double")
    high = F.lit(float(missing if posinf is None else posinf))
    low = F.lit(float(missing if neginf is None else neginf))
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(float(missing)))
        .when(c == F.lit(float("inf")), high)
        .when(c == F.lit(float("-inf")), low)
        .otherwise(c)
    )


def not_nan(c: Column | str) -> Column:
    """True for every value of a floating column but NaN, and for NULL."""
    return ~F.coalesce(F.isnan(_col(c)), F.lit(False))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (``greatest`` alone would drop it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def first_present(*cols: Column | str) -> Column:
    """The first non-missing value, an empty cell counting as missing."""
    return F.coalesce(*[F.when(F.length(F.trim(_col(c).cast("string"))) > 0, _col(c)) for c in cols])


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, and 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
