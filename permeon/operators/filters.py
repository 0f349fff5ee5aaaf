"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.cleaning import not_nan
from permeon.operators.projection import is_missing, keep_threshold


def drop_null(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with any (or only) missing cells among ``subset``."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> DataFrame:
    """Keep rows with at least ``share`` of the cells filled."""
    filled = sum((F.when(is_missing(df, c), 0).otherwise(1) for c in cols), F.lit(0))
    return df.filter(filled >= keep_threshold(len(cols), share))


def _not_nan(df: DataFrame, col: str) -> Column:
    return not_nan(col) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else F.lit(True)


def filter_range(
    df: DataFrame,
    col: str,
    lo: float | None = None,
    hi: float | None = None,
    lo_inclusive: bool = True,
    hi_inclusive: bool = True,
    keep_null: bool = False,
) -> DataFrame:
    """Range filter with either kind of bound; NULL goes unless ``keep_null``, and NaN counts as NULL."""
    missing = F.col(col).isNull() | ~_not_nan(df, col)
    c = F.col(col)
    keep: Column = ~missing
    if lo is not None:
        keep &= (c >= lo) if lo_inclusive else (c > lo)
    if hi is not None:
        keep &= (c <= hi) if hi_inclusive else (c < hi)
    return df.filter(keep | missing if keep_null else keep)


def facet_filter(
    df: DataFrame,
    facets: Mapping[str, Sequence],
    keep_null: Sequence[str] = (),
    optional: Sequence[str] = ("prediction",),
) -> DataFrame:
    """Every facet's value must be in its set.

    For an ``optional`` facet an empty set means no filter; for others it means
    no rows. Facets named in ``keep_null`` let missing values through.
    """
    for col, wanted in facets.items():
        if not wanted and col in optional:
            continue
        hit = F.col(col).isin(list(wanted)) if wanted else F.lit(False)
        df = df.filter(hit | F.col(col).isNull() if col in keep_null else hit)
    return df


def property_search(
    df: DataFrame,
    ranges: Mapping[str, tuple[float | None, float | None]],
    prediction: tuple[str, str] | None = None,
    min_confidence: tuple[str, float] | None = None,
) -> DataFrame:
    """Stored results within closed property ranges, of one class, above a confidence."""
    for col, (lo, hi) in ranges.items():
        df = filter_range(df, col, lo, hi)
    if prediction:
        df = df.filter(F.col(prediction[0]) == prediction[1])
    if min_confidence:
        df = filter_range(df, min_confidence[0], lo=min_confidence[1])
    return df


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is missing or only white space."""
    return df.filter(F.col(col).rlike(r"\S"))
