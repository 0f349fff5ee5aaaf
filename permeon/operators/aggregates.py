"""Counts, profiles, summaries and replicate packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.cleaning import finite_or_null, safe_ratio
from permeon.functions.labels import NEGATIVE, POSITIVE
from permeon.operators.ordering import ranked
from permeon.operators.projection import is_missing
from permeon.operators.quantiles import approx_quantiles, exact_quantiles

PACK_SIZE = 1000


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Rows per value and the share of all counted rows in percent."""
    rows = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.lit(100.0) * F.col("n") / total)


def nunique_by(df: DataFrame, key: str, value: str, name: str = "n_values") -> DataFrame:
    """Distinct values per key, 0 where all are missing; more than one means a conflict.

    Two aggregations, so that the values of a hot key are first made distinct
    across tasks.
    """
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(name))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column and their share, in one pass."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    long = row.unpivot(["rows"], cols, "column", "nulls")
    return long.select("column", "nulls", safe_ratio(F.col("nulls"), F.col("rows")).alias("share"))


def count_incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How many rows have any missing cell."""
    any_missing: Column = F.lit(False)
    for c in cols or df.columns:
        any_missing |= is_missing(df, c)
    return df.agg(F.count_if(any_missing).alias("incomplete_rows"))


DESCRIBE_SCHEMA = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")]
)


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (linear interpolation), maximum."""
    aggs = []
    for i, c in enumerate(cols):
        v = finite_or_null(F.col(f"`{c}`"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"a{i}"),
            F.max(v).alias(f"z{i}"),
        ]
    row = df.agg(*aggs).first()
    quartiles = (exact_quantiles if exact else approx_quantiles)(df, cols, [0.25, 0.5, 0.75])
    rows = [
        (c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *quartiles[c], row[f"z{i}"])
        for i, c in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


def batch_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by`` group): counts, rates and means of a scored batch.

    Means are over successful rows, a missing figure counting as 0; every rate
    is 0 where its base is empty.
    """
    ok = F.col("status") == "Success"
    total, good = F.count(F.lit(1)), F.count_if(ok)
    positive = F.count_if(ok & (F.col("prediction") == POSITIVE))
    negative = F.count_if(ok & (F.col("prediction") == NEGATIVE))

    def mean_of(c: str) -> Column:
        return F.coalesce(F.avg(F.when(ok, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0)).alias(f"avg_{c}")

    return results.groupBy(*by).agg(
        total.alias("total"),
        good.alias("successful"),
        F.count_if(F.col("status") == "Error").alias("failed"),
        (safe_ratio(good, total) * 100).alias("success_rate"),
        positive.alias("positive_count"),
        negative.alias("negative_count"),
        (safe_ratio(positive, good) * 100).alias("positive_rate"),
        mean_of("confidence"),
        mean_of("uncertainty"),
        mean_of("agreement"),
    )


def class_profile(df: DataFrame, cls: str, props: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each property per class, and the class share."""
    stats = [
        e
        for p in props
        for e in (F.avg(p).alias(f"{p}_mean"), F.stddev_samp(p).alias(f"{p}_std"))
    ]
    grouped = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), *stats)
    total = grouped.agg(F.sum("n")).scalar()
    return grouped.withColumn("share", F.lit(100.0) * F.col("n") / total)


def pack_replicates(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str], pack_size: int = PACK_SIZE
) -> DataFrame:
    """Ordered lists of every replicate's values, at most ``pack_size`` per row.

    An ordinary key gives one row (``pack`` 0). A key with more replicates goes
    on in further rows, numbered in order, so nothing is lost and no list grows
    without bound. Missing values keep their place.
    """
    placed = ranked(df, order, by=keys, name="__pos")
    packed = (
        placed.withColumn("pack", F.floor(F.col("__pos") / pack_size).cast("bigint"))
        .groupBy(*keys, "pack")
        .agg(F.array_sort(F.collect_list(F.struct("__pos", *cols))).alias("__items"))
    )
    return packed.select(
        *keys,
        "pack",
        F.size("__items").cast("bigint").alias("n"),
        *[F.col(f"__items.{c}").alias(c) for c in cols],
    )


def pack_text(values: Column, sep: str = "|") -> Column:
    """A packed list as one cell, the form used at file edges."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep, "nan")


def unpack_text(cell: Column, sep: str = r"\|") -> Column:
    return F.filter(F.split(cell, sep), lambda v: v != "")


def drop_discordant(df: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """Rows of those keys whose replicates span at most ``tolerance``."""
    spans = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("__span"))
    agreeing = spans.filter(F.col("__span") <= tolerance).drop("__span")
    return df.join(agreeing, list(keys), "left_semi")


def split_by_presence(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a measured value, rows without)."""
    missing = is_missing(df, col)
    return df.filter(~missing), df.filter(missing)
