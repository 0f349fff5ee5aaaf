"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

A SimHash of 64 bits cannot find these: at 0.8 about ten bits differ, so segments
short enough to agree would be shared by everything. Candidates are therefore the texts of
one SimHash component and, beside these, those that agree in a band of MinHash rows (a pair
at 0.8 is missed with probability 3e-6). Every link is verified by the exact similarity of
the two sets.

Texts with equal sets are one node. A band's members are linked to one pivot first.
Groups that are not yet one component get their members' sets; a task compares those
of different components, by signature and then by set, and sends no pairs but the
links that join components, fewer than members. Groups of more than GROUP nodes, or of
more than BLOCK_BYTES of sets, are compared in pairs of blocks.

Defined results: words are split at blanks, A-Z are lower-cased. A text of fewer words than
a shingle has one shingle, all of them; texts with no word are equal. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import LOWER, NOT_BLANK, in_arrow, mix, ragged, range_hashes, split_words, stored, text_blocks, window_hashes
from permeon.llm.components import components
from permeon.llm.simhash import CELL_BITS, GROUP, cells, first_of_each, near_duplicates

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of whole numbers so that it is exact.
LEAST = (4, 5)
BANDS, ROWS, SEED = 32, 5, 42
#: Of BANDS * ROWS signature bytes; at 0.8 fewer agree with probability 3e-6.
LEAST_AGREE = 104

_rng = np.random.default_rng(SEED)
_FLIPS, _FACTORS = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


#: Bytes of shingle sets in one block of a group.
BLOCK_BYTES = 4 << 20
#: A polynomial hash cannot tell some texts of a thousand letters apart; longer words get a digest.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = range_hashes(data, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document; document i has values[first[i]:first[i + 1]], one at least."""
    low = LOWER[data]
    words = split_words(low, offsets, NOT_BLANK)
    hashes, count = word_hashes(low, words.starts, words.ends), np.diff(words.first)
    long, short = np.flatnonzero(count >= SHINGLE_WORDS), np.flatnonzero(count < SHINGLE_WORDS)
    sizes = count[long] - SHINGLE_WORDS + 1
    whole = [window_hashes(hashes[a : a + n], n)[0] if n else 0 for a, n in zip(words.first[short].tolist(), count[short].tolist(), strict=True)]
    values = np.concatenate((window_hashes(hashes, SHINGLE_WORDS)[ragged(words.first[long], sizes)], np.array(whole, np.uint64)))
    owner = np.concatenate((np.repeat(long, sizes), short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def set_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of every document's set."""
    return mix(np.add.reduceat(mix(values + np.uint64(SEED)), first[:-1]))


def minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash rows of every document."""
    out = np.empty((len(first) - 1, BANDS * ROWS), np.uint64)
    for i, (flip, factor) in enumerate(zip(_FLIPS, _FACTORS, strict=True)):
        out[:, i] = np.minimum.reduceat((values ^ flip) * factor, first[:-1])
    return mix(out)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for every document and band."""
    bands = rows.reshape(len(rows), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        keys = mix(keys * np.uint64(_FACTORS[i]) ^ bands[:, :, i])
    return keys


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values; value i has the bytes values[bounds[i]:bounds[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, hash of the shingle set ``fp``, signature and band keys of every row."""
    rows = docs.select(F.col("text").alias("_text"), "doc_id", F.xxhash64("text").alias("text_hash"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def of_batches(batches):
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                values, first = shingle_sets(block.data, block.offsets)
                found = minima(values, first)
                bands = band_keys(found).view(np.int64)
                n = len(bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(block.first, n) for i in (1, 2)),
                        pa.array(set_hashes(values, first).view(np.int64)),
                        _binary(found.astype(np.uint8), np.arange(n + 1) * BANDS * ROWS),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                    ],
                    ["doc_id", "text_hash", "fp", "signature", "keys"],
                )

    return rows.transform(in_arrow, of_batches, f"doc_id {key}, text_hash bigint, fp bigint, signature binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and the shingle hashes of every wanted ``key``, and of the few others that share a cell of the bitmap."""
    bitmap = cells(wanted)

    def of_batches(batches):
        bits = np.unpackbits(bitmap.value).astype(bool)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                values, first = shingle_sets(block.data, block.offsets)
                names, at = np.unique(set_hashes(values, first), return_index=True)
                asked = bits[(names >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                names, at = names[asked], at[asked]
                sizes = first[at + 1] - first[at]
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), _binary(values[ragged(first[at], sizes)], 8 * bounds)], ["fp", "shingles"])

    found = docs.select(F.col("text").alias("_text")).transform(in_arrow, of_batches, "fp bigint, shingles binary")
    return found.groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _near(batches):
    """The pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = 0
            if LEAST[1] * min(len(x), len(y)) >= LEAST[0] * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["u", "v"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that are near copies."""
    b = pairs.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    both = b.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b")
    return stored(both.transform(in_arrow, _near, "u bigint, v bigint"), "near-copies")


def _forest(fp, comp, block, rows, shingles: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of one group's members: near copies by signature, then by set.

    Members of two blocks are compared across only. What is linked already is not compared again.
    """
    sizes = np.array([len(x) for x in shingles])
    first = np.concatenate(([0], np.cumsum(sizes)))
    names, numbers = np.unique(np.concatenate(shingles), return_inverse=True)
    flags, two, found = np.zeros(len(names), np.int64), block.min() != block.max(), []
    for i in range(len(fp) - 1):
        other = np.arange(i + 1, len(fp))
        some = (comp[other] != comp[i]) & (LEAST[1] * np.minimum(sizes[other], sizes[i]) >= LEAST[0] * np.maximum(sizes[other], sizes[i]))
        if two:
            some &= block[other] != block[i]
        other = other[some]
        other = other[(rows[other] == rows[i]).sum(axis=1) >= LEAST_AGREE]
        if not len(other):
            continue
        own = numbers[first[i] : first[i + 1]]
        flags[own] = 1
        both = np.add.reduceat(flags[numbers[ragged(first[other], sizes[other])]], np.cumsum(sizes[other]) - sizes[other])
        flags[own] = 0
        for j in other[LEAST[1] * both >= LEAST[0] * (sizes[other] + sizes[i] - both)].tolist():
            if comp[j] != comp[i]:
                found.append((min(fp[i], fp[j]), max(fp[i], fp[j])))
                comp[comp == comp[j]] = comp[i]
    return found


def _across(batches):
    """Links between a group's members in different components."""
    for batch in batches:
        found = []
        for members in batch.column(0):
            fields = [members.values.field(i) for i in range(5)]
            fp, root, block = (np.array(f, np.int64) for f in fields[:3])
            rows = np.frombuffer(b"".join(fields[3].to_pylist()), np.uint8).reshape(len(fp), -1)
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in fields[4]]
            found += _forest(fp, root, block, rows, shingles)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def simhash_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, fp): the sets of the texts of each SimHash component; ``rows`` has the set of each text."""
    found = near_duplicates(docs)
    name = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col("fingerprint")))
    named = found.select("text_hash", F.xxhash64(F.lit("simhash"), name).alias("key")).distinct()
    return rows.select("text_hash", "fp").distinct().join(named, "text_hash").select("key", "fp").distinct()


def links(docs: DataFrame, nodes: DataFrame, group: int = GROUP, groups: DataFrame | None = None) -> DataFrame:
    """(u, v) links that connect all distinct ``fp`` that are near copies; ``groups`` are candidates besides those of the bands."""
    signed = nodes.select(F.explode("keys").alias("key"), "fp")
    signed = signed if groups is None else signed.unionByName(groups)
    sizes = signed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where("n > 1")
    shared = stored(signed.join(sizes, "key"), "bands")
    sets = stored(_sets(docs, shared.select(F.col("fp").alias("key"))), "shingles")

    def unsettled(found: DataFrame) -> DataFrame:
        """Rows of the groups that are not one component, with the component of each node and of the pivot."""
        roots = components(found).withColumnRenamed("node", "fp")
        rows = shared.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("fp", "root")).alias("first"))
        several = several.where("lo <> hi").select("key", F.col("first.root").alias("pivot_root"))
        return rows.join(several, "key")

    found = verified(shared.groupBy("fp").agg(F.min("pivot").alias("u")).where("u <> fp").select("u", F.col("fp").alias("v")), sets)
    pairs = unsettled(found).where("root <> pivot_root").select(F.col("pivot").alias("u"), F.col("fp").alias("v")).distinct()
    found = found.union(verified(pairs, sets))
    open_rows = unsettled(found).join(nodes.select("fp", "signature"), "fp").join(sets, "fp")
    heavy = open_rows.groupBy("key").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("bytes") / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("key", "fp"), blocks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = open_rows.join(heavy, "key").select("key", block.alias("i"), every.alias("j"), F.struct("fp", "root", block.alias("block"), "signature", "shingles").alias("member"))
    grouped = dealt.groupBy("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list("member").alias("members"))
    rest = grouped.select("members").transform(in_arrow, _across, "u bigint, v bigint")
    return found.union(stored(rest, "near-copies"))


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash and ``component``, a number that near copies share, of every row."""
    rows = stored(sketches(docs), "sketches")
    nodes = stored(rows.groupBy("fp").agg(F.first("signature").alias("signature"), F.first("keys").alias("keys")), "distinct-sets")
    roots = components(links(docs, nodes, group, simhash_groups(docs, rows))).withColumnRenamed("node", "fp")
    return rows.select("doc_id", "text_hash", "fp").join(roots, "fp", "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("component"))


def one_of_near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row of every component, as :func:`first_of_each` picks it."""
    return first_of_each(docs, near_copies(docs, group), F.col("component"))
