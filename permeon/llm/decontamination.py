r"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of consecutive words; a document word is hit if
an occurrence of a window covers it. A window lies in a document only if all its
shingles do, so one "prefix" shingle decides which documents are looked at: the
rarest of the window, by its count over the whole corpus. Documents give, for each
place where a prefix shingle occurs, that place and the words around it; an
equality join on the shingle brings them to the windows. Length and place of the
shingle in the window say where the window would have to lie, and the words
themselves are compared.

The benchmark may be of any size: nothing of it is broadcast but a bitmap of
CELLS bits, which only spares candidates that cannot match. Results depend on the text
alone, so equal texts are one text until the last join.

Defined results: a null or empty text or item has no words. Of repeated items each id
counts once. A null item id hits, but is not listed or counted. Columns other than
those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import LOWER, WORD_BYTES, Words, in_arrow, mix, range_hashes, split_words, stored, text_blocks, window_hashes

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Bits of the bitmap of shingles, 512 KB.
CELL_BITS = 22


def _shingles(words: Words, hashes: np.ndarray, k: int):
    """(place, hash) of every k consecutive words that lie in one document."""
    h = mix(window_hashes(hashes, k) ^ np.uint64(k))
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(hashes))
    at = np.flatnonzero(room[: len(h)] >= k)
    return at, h[at]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _block_words(block):
    low = LOWER[block.data]
    words = split_words(low, block.offsets, WORD_BYTES)
    return low, words, range_hashes(low, words.starts, words.ends)


def _joined(low: np.ndarray, words: Words, a: int, b: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True))


def item_shingles(benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """item, window (its words, space-joined), words, and hash, size and place of each shingle of the window."""
    rows = benchmark.select(F.col("text").alias("_text"), F.col("item_id").cast("string").alias("item"))

    def of_batches(batches):
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                low, words, hashes = _block_words(block)
                by_size = {}
                item, text, size, h, ks, place = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    w = min(window, b - a)
                    k = min(shingle, w)
                    if not w:
                        continue
                    if k not in by_size:
                        values = np.zeros(len(hashes), np.uint64)
                        at, found = _shingles(words, hashes, k)
                        values[at] = found
                        by_size[k] = values
                    for start in range(a, b - w + 1):
                        own = _joined(low, words, start, start + w).decode("utf-8", "replace")
                        for j in range(w - k + 1):
                            item.append(block.first + i)
                            text.append(own)
                            size.append(w)
                            h.append(by_size[k][start + j])
                            ks.append(k)
                            place.append(j)
                columns = [batch.column(1).take(pa.array(item, pa.int64())), pa.array(text, pa.string()), pa.array(size, pa.int32())]
                columns += [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(ks, pa.int32()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "window", "words", "h", "k", "place"])

    return rows.transform(in_arrow, of_batches, "item string, window string, words int, h bigint, k int, place int")


def _bitmap(shingles: DataFrame):
    """Packed bits of the cells that hold a shingle, and the shingle sizes."""
    cell = F.expr(f"shiftrightunsigned(h, {64 - CELL_BITS})")
    cells = shingles.select(cell.alias("c")).distinct().toArrow().column("c").to_numpy()
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())
    bits = np.zeros(1 << CELL_BITS, bool)
    bits[cells] = True
    return shingles.sparkSession.sparkContext.broadcast((np.packbits(bits), sizes))


def corpus_counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(h, n): occurrences in the whole corpus of the given shingles, and of few others."""
    shared = _bitmap(shingles)

    def counted(batches):
        packed, sizes = shared.value
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                _, words, hashes = _block_words(block)
                found = [h[bits[_cells(h)]] for _, h in (_shingles(words, hashes, k) for k in sizes)]
                value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return docs.select("text").transform(in_arrow, counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, prefixes: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document (h null), and one per place where a prefix shingle may occur, with the words around it."""
    shared = _bitmap(prefixes)
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.col("text").alias("_text"), "doc_id", text_key.alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def found(batches):
        packed, sizes = shared.value
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                low, words, hashes = _block_words(block)
                first = words.first
                n = len(first) - 1
                row, place, h, start, around = list(range(n)), [None] * n, [None] * n, [None] * n, [None] * n
                for k in sizes:
                    at, values = _shingles(words, hashes, k)
                    hit = bits[_cells(values)]
                    at, values = at[hit], values[hit].view(np.int64)
                    of = np.searchsorted(first, at, "right") - 1
                    for p, v, d in zip(at.tolist(), values.tolist(), of.tolist(), strict=True):
                        a, b = max(int(first[d]), p - window + 1), min(int(first[d + 1]), p + window)
                        row.append(d)
                        place.append(p - int(first[d]))
                        h.append(v)
                        start.append(a - int(first[d]))
                        around.append(_joined(low, words, a, b).decode("utf-8", "replace"))
                of_row = pa.array(np.array(row, np.int64) + block.first)
                total = pa.array(np.diff(first)[row], pa.int64())
                columns = [batch.column(1).take(of_row), batch.column(2).take(of_row), total, pa.array(h, pa.int64()), pa.array(place, pa.int64()), pa.array(start, pa.int64()), pa.array(around, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "h", "place_in_text", "start", "around"])

    return rows.transform(in_arrow, found, f"doc_id {kind}, key binary, n_words bigint, h bigint, place_in_text bigint, start bigint, around string")


def window_occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, first, end, item): where windows truly lie, in words of the text."""
    places = found.where("h IS NOT NULL").dropDuplicates(["key", "h", "place_in_text"])
    both = places.join(prefixes, "h").where("n_words >= words AND place_in_text >= place AND place_in_text - place + words <= n_words")
    inside = F.slice(F.split("around", " "), (F.col("place_in_text") - F.col("place") - F.col("start") + 1).cast("int"), F.col("words"))
    same = both.where(F.array_join(inside, " ") == F.col("window"))
    begin = F.col("place_in_text") - F.col("place")
    return same.select("key", begin.alias("first"), (begin + F.col("words")).alias("end"), "item").distinct()


def _covered(spans):
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def add(a, x):
        more = F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["reach"], x["first"]))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key (md5 of the text), n_words, n_hit, items (sorted ids) of every row."""
    shingles = stored(item_shingles(benchmark, window, shingle), "item-shingles")
    counts = corpus_counts(docs, shingles)
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place", "k")
    ranked = shingles.join(counts, "h", "left").groupBy("item", "window", "words").agg(F.min(rarity).alias("r"))
    prefixes = stored(ranked.select("item", "window", "words", "r.h", "r.place", "r.k"), "prefix-shingles")
    found = stored(candidates(docs, prefixes, window), "candidates")
    hits = window_occurrences(found, prefixes).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    hits = hits.select("key", _covered(F.col("spans")).alias("n_hit"), "items")
    rows = found.where("h IS NULL").select("doc_id", "key", "n_words")
    none = F.array().cast("array<string>")
    return rows.join(hits, "key", "left").select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not contaminated."""
    bad = find_contamination(docs, benchmark).where(is_contaminated()).select(F.col("key").alias("_bad")).distinct()
    return docs.join(bad, F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))) == F.col("_bad"), "left_anti")
