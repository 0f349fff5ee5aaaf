"""Incremental operators: score and insert, resumable append, first-seen dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from permeon.sources.store import ResultStore


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_score(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    store: ResultStore,
    order: Sequence[str],
    checkpoint: str,
    name: str | None = None,
) -> StreamingQuery:
    """Score what has arrived and insert the new keys.

    A batch's number is committed with its rows, under ``name`` (the checkpoint's
    path if not given): one that is run again after a failure, its rows being in, is
    neither scored nor compared. With a new checkpoint numbers start again; give a
    new name then, and keys that are there are still written once.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        store.insert(score(batch), order, (name or checkpoint, batch_id))

    return (
        source.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_append(
    source: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Append results as inputs arrive; a restart goes on after the last finished batch."""
    return (
        fn(source)
        .writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_dedup(source: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First arrival per key.

    For the table's lifetime this keeps every key as state. With ``event_time``
    the state is bounded: a key is forgotten ``delay`` after it was seen.
    """
    if event_time is None:
        return source.dropDuplicates([key])
    return source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_first_rows(source: DataFrame, store: ResultStore, order: Sequence[str], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """First row of each key over the table's lifetime, without streaming state.

    The keys seen are the store's rows on disk; a batch reads the buckets its own keys
    fall into, and memory does not grow with the number of keys. Within a batch
    the first in ``order`` counts.
    """
    return stream_score(source, lambda batch: batch, store, order, checkpoint, name)


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query, raising its error if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


