"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch; the session's setting is lowered to it.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = 8, app: str = "permeon") -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    On a cluster that setting must name storage every executor can reach. Only
    a ``local[...]`` master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="permeon-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def bucket_count(spark: SparkSession) -> int:
    """How many pieces one sort key is cut into; follows the cluster's setting."""
    return max(32, min(20_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly if the scan has fewer partitions than there are cores.

    For work that is heavy per row on files that do not split (gzip, or one row
    group). A scan that already fills the cluster is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of at most BATCH_BYTES (one row at least), not by rows alone."""
    number, unit = re.match(r"(-?\d+)([kmgt]?)", spark.conf.get(_BATCH_SETTING).lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes; the worker gives freed memory back after each task."""
    bound_batches(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Returns the allocator's free pages to the system, where the C library can: workers outlive their tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
