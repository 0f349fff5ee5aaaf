"""The data behind charts: histograms, ECDF, scatter rows, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.cleaning import finite_or_null
from permeon.operators.ordering import quantile_cuts, running_totals

HISTOGRAM_SCHEMA = T.StructType(
    [
        T.StructField("bin", T.LongType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)


def histogram(df: DataFrame, col: str, bins: int = 10, discrete: bool = False) -> DataFrame:
    """Equal-width bins over [min, max] with the last one closed, empty bins included.

    ``discrete`` counts whole numbers with unit-width bins centred on them.
    """
    x = finite_or_null(F.col(col))
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    if discrete:
        counts = values.groupBy(F.round("x").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        ends = counts.agg(F.min("bin"), F.max("bin")).first()
        if ends[0] is None:
            return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
        every = df.sparkSession.range(ends[0], ends[1] + 1).withColumnRenamed("id", "bin")
        filled = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return filled.select("bin", (F.col("bin") - 0.5).alias("lo"), (F.col("bin") + 0.5).alias("hi"), "n")
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    x = finite_or_null(F.col(col))
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, "x", {"upto": F.col("n")}, cuts=quantile_cuts(values, ["x"]), totals={"upto": "total"})
    return run.select("x", "n", (F.col("upto") / F.col("total")).alias("proportion"))


def scatter_rows(
    results: DataFrame,
    x: str = "confidence",
    y: str = "uncertainty",
    cls: str = "prediction",
    text: str = "name",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(trace, x, y, text) of every successful row, one trace per class."""
    return results.filter(F.col("status") == "Success").select(
        *keep,
        F.coalesce(F.col(cls), F.lit("Unknown")).alias("trace"),
        F.coalesce(F.col(x), F.lit(0.0)).alias("x"),
        F.coalesce(F.col(y), F.lit(0.0)).alias("y"),
        F.coalesce(F.col(text), F.lit("Unknown")).alias("text"),
    )


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after balancing, side by side."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias(name))

    both = counts(before, "n_before").join(counts(after, "n_after"), label, "full")
    return both.select(
        label, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")
    )


def metrics_long(metrics: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide metric table to (ids, metric, value)."""
    return metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(ids), list(names), "metric", "value"
    )
