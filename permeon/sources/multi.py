"""Reading many per-source folders as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: source folders are named R1, R2, ...
SOURCE_FOLDER = r"[/=]R(\d+)/"


def read_sources(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, fmt: str = "json", **options
) -> DataFrame:
    """All source folders in one scan, tagged with ``source_no`` and ``reference``.

    ``paths`` is a list of folders or a glob over them. The tag comes from the
    file's own path, so nothing has to be read folder by folder. Sort by
    ``source_no`` where the source order matters.
    """
    df = spark.read.format(fmt).schema(schema).options(**options).load(paths)
    number = F.regexp_extract(F.col("_metadata.file_path"), SOURCE_FOLDER, 1).try_cast("int")
    return df.select("*", number.alias("source_no"), F.concat(F.lit("R"), number).alias("reference"))
