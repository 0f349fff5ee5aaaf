"""Reproducible pseudo-random draws.

Every draw is a pure function of the row key and a seed, so a retried task, a
different partitioning or another SQL engine gives the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(seed: int | str, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2**60) from md5 of ``key|...|seed``."""
    text = F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def unit_draw(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(float(2**DRAW_BITS))
