"""Rounding and fixed-point display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even, as the numeric stack of the original flow does."""
    return F.bround(_col(c), digits)


def hundredths(c: Column | str) -> Column:
    """Value rounded to 2 decimals, carried as an exact integer of hundredths."""
    return F.round(F.bround(_col(c).cast("double"), 2) * 100).cast("bigint")


def decimals_in_hundredths(h: Column) -> Column:
    """Digits after the point when ``h/100`` is printed: one if it ends in 0, else two."""
    return F.when(h % 10 == 0, 1).otherwise(2)


def halves_even_div(num: Column, den: Column) -> Column:
    """Integer quotient num/den rounded half to even, exact for any sign (den > 0)."""
    rest = F.pmod(num, den)
    down = F.call_function("div", num - rest, den)
    up = (rest * 2 > den) | ((rest * 2 == den) & (F.pmod(down, F.lit(2)) == 1))
    return down + F.when(up, 1).otherwise(0)


def min_scale(texts: Column | str) -> Column:
    """Fewest digits after the decimal point over an array of number texts."""
    return F.array_min(F.transform(_col(texts), scale_of))


def scale_of(text: Column) -> Column:
    """Digits after the decimal point of one number text (0 without a point)."""
    return F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(0)


def fixed(c: Column | str, digits: int, missing: str | None = "N/A") -> Column:
    """Fixed decimals for display; a missing value reads ``N/A``, a zero stays a zero."""
    c = _col(c).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.bround(c, digits))).otherwise(F.lit(missing))
