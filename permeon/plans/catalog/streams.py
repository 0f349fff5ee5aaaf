"""Structured Streaming jobs run to the end over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from permeon.functions.labels import encode_label
from permeon.plans.catalog.registry import Tables, query
from permeon.session import scratch_dir
from permeon.sources.store import ResultStore
from permeon.streaming.micro_batch import run_to_end, stream_append, stream_dedup, stream_files, stream_first_rows, stream_score


def _events(spark, d):
    return stream_files(spark, d, Tables(spark, d).events.schema, glob="events.parquet")


def _scored(batch):
    label = F.when(F.col("value") >= 50, "BBB+").otherwise("BBB-")
    return batch.select(
        F.col("user_id").cast("string").alias("key"),
        encode_label(label).alias("prediction"),
        F.col("value").alias("confidence"),
        "event_id",
    )


@query(
    "stream_score_insert",
    """SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS prediction, value AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
)
def stream_score_insert(spark, d):
    schema = _scored(Tables(spark, d).events).drop("event_id").schema
    store = ResultStore(spark, scratch_dir(spark, "scored"), schema, "key", buckets=8)
    checkpoint = scratch_dir(spark, "checkpoint")
    for _ in range(2):  # the second run finds nothing left to do
        run_to_end(stream_score(_events(spark, d), _scored, store, ["event_id"], checkpoint))
    return store.read()


@query(
    "stream_resumable_append",
    "SELECT event_id, user_id, round(value * 2, 2) AS doubled FROM events WHERE event_type <> 'error'",
)
def stream_resumable_append(spark, d):
    def work(df):
        ok = df.filter(F.col("event_type") != "error")
        return ok.select("event_id", "user_id", F.round(F.col("value") * 2, 2).alias("doubled"))

    out, checkpoint = scratch_dir(spark, "appended"), scratch_dir(spark, "checkpoint")
    for _ in range(2):
        run_to_end(stream_append(_events(spark, d), work, out, checkpoint))
    return spark.read.schema(work(Tables(spark, d).events).schema).parquet(out)


@query("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    out, checkpoint = scratch_dir(spark, "seen"), scratch_dir(spark, "checkpoint")
    source = _events(spark, d)
    run_to_end(stream_append(source, lambda s: stream_dedup(s.select("user_id"), "user_id"), out, checkpoint))
    return spark.read.schema("user_id bigint").parquet(out)


@query("stream_first_seen_bounded", "SELECT DISTINCT user_id FROM events")
def stream_first_seen_bounded(spark, d):
    out, checkpoint = scratch_dir(spark, "seen"), scratch_dir(spark, "checkpoint")

    def work(s):
        return stream_dedup(s.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "365 days").select("user_id")

    run_to_end(stream_append(_events(spark, d), work, out, checkpoint))
    return spark.read.schema("user_id bigint").parquet(out)


@query(
    "stream_first_seen_stored",
    "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
)
def stream_first_seen_stored(spark, d):
    source = _events(spark, d).select("user_id", "event_id")
    store = ResultStore(spark, scratch_dir(spark, "first-rows"), source.schema, "user_id", buckets=8)
    checkpoint = scratch_dir(spark, "checkpoint")
    for _ in range(2):
        run_to_end(stream_first_rows(source, store, ["event_id"], checkpoint))
    return store.read()
