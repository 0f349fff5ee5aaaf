"""Where user code plugs in: per value, per column, per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_or_null(df: DataFrame, col: str, fn: Callable[[object], object], dtype: str, out: str) -> DataFrame:
    """Per-value function, NULL where it fails. Use a built-in expression if there is one."""

    def guarded(value):
        try:
            return None if value is None else fn(value)
        except Exception:
            return None

    @F.pandas_udf(dtype)
    def run(values: pd.Series) -> pd.Series:
        return values.map(guarded, na_action="ignore").astype("object")

    return df.withColumn(out, run(F.col(col)))


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, by: list[str] | None = None
) -> DataFrame:
    """Frame in, frame out: per Arrow batch, or per group for groups that are known to be small."""
    if by:
        return df.groupBy(*by).applyInPandas(fn, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def map_expression(df: DataFrame, col: str, fn: Callable[[Column], Column], out: str) -> DataFrame:
    """The preferred form of :func:`map_or_null`: a column expression, which stays in the JVM."""
    return df.withColumn(out, fn(F.col(col)))
