"""Deduplication, ordering, slices and top-k.

Keyed dedup is an aggregation rather than a window: repeats are merged on the
map side, so a key that holds a third of the table never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.operators.ordering import ranked, sort_columns


def _order_struct(df: DataFrame, order: Sequence[str]) -> Column:
    """Sort key whose missing parts come last."""
    return F.struct(*[e for i, c in enumerate(order) for e in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (missing last)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(F.lit(1).alias("__one"), *rest), _order_struct(df, order)).alias("__row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def dedup_none(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key occurs once; every copy of a repeated key goes."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row")
    )
    single = counted.filter(F.col("__n") == 1)
    return single.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def count_duplicates(df: DataFrame, keys: Sequence[str], digest: bool = False) -> DataFrame:
    """Rows after the first per key, as one number.

    ``digest`` groups long texts by SHA-256, so the shuffle carries 64
    characters instead of the text.
    """
    cols = [F.sha2(F.col(k), 256).alias(k) if digest else F.col(k) for k in keys]
    groups = df.select(*cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def order_rows(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool] | bool = True) -> DataFrame:
    """Total sort with missing keys last in both directions."""
    return df.orderBy(*sort_columns(keys, ascending))


def natural_key(col: str, pattern: str) -> Column:
    """The number a pattern's first group finds, for ordering ``x_2`` before ``x_10``."""
    return F.regexp_extract(F.col(col), pattern, 1).try_cast("bigint")


def natural_sort(df: DataFrame, col: str, pattern: str = r"_(\d+)$") -> DataFrame:
    return df.orderBy(natural_key(col, pattern).asc_nulls_last(), F.col(col))


def slice_rows(df: DataFrame, order: Sequence[str] | str, start: int, stop: int, keep_pos: bool = False) -> DataFrame:
    """Rows [start, stop) of the stated order."""
    placed = ranked(df, order, name="row_pos").filter((F.col("row_pos") >= start) & (F.col("row_pos") < stop))
    return placed if keep_pos else placed.drop("row_pos")


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k best rows, in order: descending score, then ``ties`` ascending, missing values last.

    Rows are cut by exact position, so those of a large k are never brought
    together in one task.
    """
    order, up = [score, *ties], [False] + [True] * len(ties)
    placed = ranked(df, order, name="__pos", ascending=up).filter(F.col("__pos") < k)
    return placed.orderBy("__pos").drop("__pos")


def best_by(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """The single row with the highest metric; ``tie`` ascending decides equals."""
    top = df.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col(tie)).limit(1)
    return top
