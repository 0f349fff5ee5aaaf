"""Line-oriented sources and sinks, and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.functions.text import strip


def read_lines(spark: SparkSession, path: str | list[str], name: str = "input") -> DataFrame:
    """One entity per line, trimmed, blank lines dropped."""
    lines = spark.read.text(path).select(strip("value").alias(name))
    return lines.filter(F.length(name) > 0)


def split_lines(df: DataFrame, text: str, name: str = "input") -> DataFrame:
    """The same for a text column: one output row per non-blank line, with its line number."""
    lines = df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "__line"),
    )
    return (
        lines.withColumn(name, strip("__line")).drop("__line").filter(F.length(name) > 0)
    )


def write_lines(df: DataFrame, cols: Sequence[str], path: str, mode: str = "errorifexists", sep: str = "\t") -> None:
    """Key, or key and id, without a header; rows without a key are dropped."""
    key, *rest = cols
    cells: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]
    line = F.concat_ws(sep, F.col(key).cast("string"), *cells)
    df.filter(F.col(key).isNotNull()).select(line.alias("value")).write.mode(mode).text(path)


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object, NULL fields written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export as JSON records, one object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
