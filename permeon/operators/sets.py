"""Unions, name-set algebra, distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.operators.projection import is_missing


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name, keeping duplicates; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def schema_diff(a: Sequence[str], b: Sequence[str]) -> dict[str, list[str]]:
    """Names in both, only in ``a``, only in ``b``; each sorted."""
    left, right = set(a), set(b)
    return {"both": sorted(left & right), "only_a": sorted(left - right), "only_b": sorted(right - left)}


def schema_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column name of either table: where it occurs and how many cells are filled.

    Two aggregates feed it, one scan per table whatever the width.
    """
    diff = schema_diff(a.columns, b.columns)
    side = {n: s for s, names in diff.items() for n in names}

    def filled(df: DataFrame, label: str) -> DataFrame:
        row = df.agg(*[F.count_if(~is_missing(df, c)).alias(c) for c in df.columns])
        return row.unpivot([], list(df.columns), "column", label)

    names = F.create_map(*[F.lit(x) for kv in side.items() for x in kv])
    return (
        filled(a, "filled_a")
        .join(filled(b, "filled_b"), "column", "full")
        .select("column", names[F.col("column")].alias("side"), "filled_a", "filled_b")
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_distinct(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values per column, exact or by sketch."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[fn(F.col(c)).alias(c) for c in cols])
