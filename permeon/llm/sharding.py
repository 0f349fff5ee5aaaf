"""Sharding by longest-processing-time scheduling.

Documents with equal text form a group that stays together. Groups, largest
first, go to the least-loaded shard through a heap.

The heap runs on the driver over a bounded list, whatever the corpus: a group of
more than 1/LARGE of a shard's fair share stands for itself (there can be at most
LARGE * shards of these), and all smaller ones are put, by their hash, into
BUNDLES bundles that are scheduled as one piece each. The schedule, likewise
bounded, is broadcast; documents find their shard without a shuffle.

Defined results: a null text is an empty one. A null id is an id like any other;
equal rows share a shard and get slots of their own. An empty table gives no
rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permeon.llm.common import stored
from permeon.session import bucket_count

LARGE = 1000
BUNDLES = 1 << 16


def schedule(items: list[tuple[int, object]], shards: int) -> dict:
    """Shard of each (size, key): largest first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    place = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        place[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return place


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, by counting in hash buckets of ``order``."""
    parts = bucket_count(rows.sparkSession)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(offsets, [shard, "_part"]).withColumn("slot", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("_group"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "shard-groups")
    groups = groups.withColumn("_bundle", F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("int"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") > total // (shards * LARGE)
    single = groups.where(large).select("bytes", "_group").collect()
    bundles = groups.where(~large).groupBy("_bundle").agg(F.sum("bytes").alias("bytes")).select("bytes", "_bundle").collect()
    place = schedule([(b, (0, bytes(g))) for b, g in single] + [(b, (1, k)) for b, k in bundles], shards)
    of_group = spark.createDataFrame([(bytearray(k), s) for (kind, k), s in place.items() if kind == 0], "_group binary, _own int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in place.items() if kind == 1], "_bundle int, _shared int")
    placed = rows.withColumn("_bundle", F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("int"))
    placed = placed.join(F.broadcast(of_group), "_group", "left").join(F.broadcast(of_bundle), "_bundle", "left")
    placed = placed.withColumn("shard", F.coalesce("_own", "_shared")).select("doc_id", "size", "text_crc32", "shard", "_group")
    return with_slots(placed, "shard", ["doc_id", "_group"]).drop("_group")
