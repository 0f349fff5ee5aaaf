"""Column-level operators: project, feature blocks, pruning, the feature contract."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.cleaning import coerce_number
from permeon.operators.ordering import ranked

# Contract threshold, null budgets, and the id prefix.
MIN_OVERLAP = 0.9
MAX_NULLS = 25
MAX_NULL_SHARE = 0.5
ID_PREFIX = "Mol_"


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the columns of ``mapping`` (old name to new name), in its order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def feature_columns(
    df: DataFrame, start: str | int = 0, exclude: Sequence[str] = (), numeric_only: bool = True
) -> list[str]:
    """Ordered feature block: from a column name or position on, without the excluded ones."""
    first = df.columns.index(start) if isinstance(start, str) else start
    return [
        f.name
        for f in df.schema.fields[first:]
        if f.name not in exclude and (isinstance(f.dataType, T.NumericType) or not numeric_only)
    ]


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: extra ones dropped, absent ones NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def for_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to many columns in a single projection, however wide."""
    todo = set(cols)
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) if c in todo else F.col(f"`{c}`") for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    return for_columns(df, cols, lambda c: coerce_number(c, fill))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and for floating columns also NaN."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(cols)]
    ).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(cols)}


def prune_columns(
    df: DataFrame, cols: Sequence[str], max_nulls: int | None = MAX_NULLS, max_share: float | None = None
) -> list[str]:
    """Columns within the null budget: at most ``max_nulls`` cells and less than ``max_share`` of them."""
    n, nulls = null_counts(df, cols)
    return [
        c
        for c in cols
        if (max_nulls is None or nulls[c] <= max_nulls) and (max_share is None or nulls[c] < max_share * n)
    ]


class FeatureMismatch(ValueError):
    """Too few of the expected feature columns are present."""


def align_features(
    df: DataFrame, expected: Sequence[str], min_overlap: float = MIN_OVERLAP, subject: str = "batch", keep: Sequence[str] = ()
) -> DataFrame:
    """Columns reordered to ``expected``; absent ones become 0 and extra ones are dropped.

    Fails below ``min_overlap``, naming the first five absent columns.
    """
    have, want = set(df.columns), set(expected)
    present = len(have & want)
    missing = sorted(want - have)
    if want and present < min_overlap * len(want) - 1e-9:
        raise FeatureMismatch(
            f"Critical feature mismatch for {subject}: {present}/{len(want)} features present "
            f"({100 * present / len(want):.1f}%). Missing: {missing[:5]}... (total {len(missing)})"
        )
    return df.select(*keep, *[F.col(f"`{c}`") if c in have else F.lit(0.0).alias(c) for c in expected])


def make_id(df: DataFrame, order: Sequence[str] | str, name: str, out: str = "unique_id") -> DataFrame:
    """``Mol_<position>_<name>``, with ``Unknown`` for a missing name."""
    placed = ranked(df, order, name="__pos")
    label = F.concat(
        F.lit(ID_PREFIX), F.col("__pos").cast("string"), F.lit("_"), F.coalesce(F.col(name), F.lit("Unknown"))
    )
    return placed.withColumn(out, label).drop("__pos")


def keep_threshold(width: int, share: float) -> int:
    """Cells a row needs to be kept."""
    return math.ceil(share * width)
