"""Registered queries: each a Spark plan over the given tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by the test suite instead."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def nullable(df: DataFrame, *cols: str) -> DataFrame:
    """Optional counts and ids as doubles, which every client shows alike when some are missing."""
    return df.withColumns({c: df[c].cast("double") for c in cols})


def draw_sql(seed: int | str, *keys: str) -> str:
    """The draw of :mod:`permeon.functions.draws` in DuckDB SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 15))::BIGINT"


def half_even_sql(num: str, den: str) -> str:
    """Integer quotient rounded half to even, for den > 0."""
    rest = f"((({num}) % ({den})) + ({den})) % ({den})"
    down = f"((({num}) - ({rest})) // ({den}))"
    return (
        f"({down} + CASE WHEN ({rest}) * 2 > ({den}) OR (({rest}) * 2 = ({den}) AND ({down} % 2) <> 0) "
        f"THEN 1 ELSE 0 END)"
    )
