"""CSV / TSV scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _header(spark: SparkSession, path: str | list[str], sep: str) -> list[str]:
    first = spark.read.csv(path, sep=sep, header=False, quote='"', escape='"').head()
    return [v or f"_c{i}" for i, v in enumerate(first or [])]


def unique_names(names: list[str]) -> list[str]:
    """First copy of a repeated header stays bare, later ones get ``.1``, ``.2``, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if k == 0 else f"{n}.{k}")
    return out


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    schema: T.StructType | None = None,
    null_text: str = "None",
    multiline: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Delimited file(s) with a header line; empty cells and ``null_text`` read as NULL.

    Pass a ``schema`` for large inputs: without one Spark reads the data twice
    to infer types. Gzip files are read transparently but not split, so give
    ``partitions`` to spread their rows for the work that follows.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_text)
        .option("emptyValue", "")
        .option("multiLine", multiline)
    )
    if schema is not None:
        df = reader.option("enforceSchema", True).schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
        df = df.toDF(*unique_names(_header(spark, path, sep)))
    # Spark keeps empty strings apart from NULL only when told so; here both are missing.
    df = df.replace("", None)
    return df.repartition(partitions) if partitions else df


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", **options) -> None:
    """One part file per partition, each with a header; no row index."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .options(**options)
        .csv(path)
    )
