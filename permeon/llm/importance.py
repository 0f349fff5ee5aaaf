"""Target-distribution importance resampling on hashed word n-grams.

Texts are read as bytes: a table of 256 entries lower-cases A-Z and turns every
separator into a blank, ``bytes.split`` yields the words, and the crc32 of an n-gram
is that of its first words, carried on over a blank and the next word. Counters
reduce the buckets of a task to at most BUCKETS rows; Spark adds these up.

1. One narrow pass over the corpus and one over the target texts count the buckets.
   What reaches the driver is one row per bucket, whatever the corpus.
2. A bucket's gain is the rounded log-ratio of the two smoothed shares. A second
   narrow pass over the corpus sums the gains of a document's features.
3. Seeded Gumbel noise turns weights into keys of a draw without replacement:
   the highest keys are drawn. Their ranks come from a distributed order.

Defined results: a null or empty text has no words, no features, weight 0 and is not
drawn. A null id is drawn with the empty id's noise and goes last among ties. Repeated
rows are scored one by one; equal rows get neighbouring ranks. Empty tables give no rows;
without target texts every gain is that of the smoothing alone. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import in_arrow, stored, text_blocks
from permeon.operators.ordering import ranked

BUCKETS = 10_000
#: Word bytes stay, A-Z become a-z, all other ASCII bytes become blanks.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def feature_counts(words: list[bytes], n: int = 1, buckets: int = BUCKETS) -> Counter:
    """How many of the runs of 1 to ``n`` words fall into each bucket."""
    crc = zlib.crc32
    seeds = list(map(crc, words))
    found = Counter(h % buckets for h in seeds)
    spaced = [b" " + w for w in words] if n > 1 else []
    for k in range(1, n):
        seeds = list(map(crc, spaced[k:], seeds))
        found.update(h % buckets for h in seeds)
    return found


def _texts(batch: pa.RecordBatch):
    """The bytes of the first column, one by one."""
    for block in text_blocks(batch.column(0)):
        data, bounds = block.data.tobytes(), block.offsets.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield data[a:b]


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all rows of ``texts``."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            # The same word recurs often: words are counted first, then hashed once each.
            if n == 1:
                words: Counter = Counter()
                for text in _texts(batch):
                    words.update(words_of(text))
                for w, times in words.items():
                    found[zlib.crc32(w) % buckets] += times
            else:
                for text in _texts(batch):
                    found.update(feature_counts(words_of(text), n, buckets))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "n"])

    out = [0] * buckets
    for r in in_arrow(texts.select("text"), count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: Sequence[int], target: Sequence[int], scale: int = 1000) -> list[int]:
    """floor(scale * ln of the ratio of the smoothed shares) of every bucket."""
    size, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(scale * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))) for s, t in zip(corpus, target, strict=True)]


def noise(key: str, seed: int = 2024, scale: int = 1000) -> int:
    """Gumbel noise of a row, from the first 32 bits of a digest of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: Sequence[int], n: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    rows = docs.select(F.col("text").alias("_text"), "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    buckets, gain = len(gain), list(gain)

    def score(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in _texts(batch):
                words = words_of(text)
                n_words.append(len(words))
                n_features.append(sum(max(0, len(words) - k) for k in range(n)))
                if n > 1:
                    weight.append(sum(gain[b] * times for b, times in feature_counts(words, n, buckets).items()))
                    continue
                total = 0
                for w in words:
                    g = known.get(w)
                    if g is None:
                        if len(known) > 100_000:
                            known.clear()
                        g = known[w] = gain[zlib.crc32(w) % buckets]
                    total += g
                weight.append(total)
            keys = batch.column(2).to_pylist()
            scores = [w + noise(k, seed) for w, k in zip(weight, keys, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, score, f"doc_id {key}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """Every document with its n_words, n_features, weight, score and ``rank`` in the draw (null: not drawn).

    Drawn are the ``percent`` hundredths, rounded down, with the highest scores of the
    documents of ``least_words`` words or more.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = stored(weigh(docs, gain, n, seed), "importance")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    placed = ranked(rows.where(able), ["score", "doc_id"], name="rank", start=1, ascending=[False, True])
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")).alias("rank")
    return placed.select(*rows.columns, rank).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
