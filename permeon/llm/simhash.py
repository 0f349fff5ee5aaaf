"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit in one of their halves. Each half is therefore indexed once per bit, with that
bit as a wildcard; an equality join on these signatures finds all candidates, and
the full distance verifies them.

A signature that more than GROUP fingerprints share is refined the same way: its
members agree in that half but for one bit, so the other half must again have a
half with at most one difference, and so on. The third level fixes 53 of 64 bits,
so no group can exceed 2048 distinct fingerprints. A group emits a spanning
forest of its links, not its pairs; equal fingerprints are one node throughout.

Defined results: a text with no word has fingerprint zero and is linked like any
other. The component is named by its least non-null id (null if it has none).
Repeated rows share fingerprint and component. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import LOWER, in_arrow, mix, stored, text_blocks
from permeon.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints of a signature that one numpy search takes; at least 2048, see above.
GROUP = 2048
#: Cells of the bitmap that spares signatures of no large group; 512 KB.
CELL_BITS = 22


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text whose A-Z are lower-cased already."""
    line = b" ".join(text.split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(line))
    if len(starts) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long, of every row."""
    rows = docs.select(F.col("text").alias("_text"), "doc_id", F.xxhash64("text").alias("text_hash"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def of_batches(batches):
        for batch in batches:
            found = []
            for block in text_blocks(batch.column(0)):
                low = LOWER[block.data].tobytes()
                found += [fingerprint(low[a:b], words) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), values], ["doc_id", "text_hash", "fp"])

    return rows.transform(in_arrow, of_batches, f"doc_id {key}, text_hash bigint, fp bigint")


def _signatures(members: DataFrame, width: int, wanted=None) -> DataFrame:
    """One-wildcard variants of both halves of the ``width`` bits that start at bit ``lo``; ``lo`` then names the other half.

    ``wanted``, a broadcast bitmap of CELL_BITS-bit cells, leaves out keys whose cell is not set.
    """
    half = width // 2

    def variants(batches):
        bits = None if wanted is None else np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            key, fp = (np.array(batch.column(i), np.int64).view(np.uint64) for i in (0, 1))
            lo, found = np.array(batch.column(2), np.int64), []
            for h in (0, 1):
                part = fp >> (lo + h * half).astype(np.uint64) & np.uint64((1 << half) - 1)
                for b in range(half):
                    new = mix(mix(key + np.uint64(h * half + b + 1)) ^ part & ~np.uint64(1 << b))
                    at = slice(None) if bits is None else bits[(new >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    found.append((new[at].view(np.int64), fp[at].view(np.int64), (lo + (1 - h) * half)[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["key", "fp", "lo"])

    return members.select("key", "fp", "lo").transform(in_arrow, variants, "key bigint, fp bigint, lo int")


def cells(keys: DataFrame):
    """Broadcast bitmap of the keys' cells: 2 ** CELL_BITS bits, however many keys there are."""
    cell = F.expr(f"shiftrightunsigned(key, {64 - CELL_BITS})")
    bits = np.zeros(1 << CELL_BITS, bool)
    bits[keys.select(cell.alias("c")).distinct().toArrow().column("c").to_numpy()] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _forest(batches):
    """Links of a spanning forest of every group of fingerprints."""
    for batch in batches:
        found = []
        for members in batch.column(0):
            x = np.unique(np.array(members.as_py(), np.int64)).view(np.uint64)
            rest = np.arange(len(x))
            while len(rest):
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    now, front = front[:256], front[256:]
                    near = np.bitwise_count(x[now][:, None] ^ x[rest][None, :]) <= MAX_BITS
                    hit = near.any(axis=0)
                    found.append(np.stack([x[now][near[:, hit].argmax(axis=0)], x[rest[hit]]]))
                    front, rest = np.append(front, rest[hit]), rest[~hit]
        links = np.concatenate(found, axis=1).view(np.int64) if found else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["u", "v"])


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v) links that connect all distinct ``fp`` values with at most MAX_BITS differing bits."""
    members, found = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("lo")), []
    for width in (64, 32, 16):
        signed = _signatures(members, width)
        sizes = signed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        sizes = stored(sizes.where("n > 1"), "signatures")
        found.append(sizes.where(f"n = 2 AND bit_count(u ^ v) <= {MAX_BITS}").select("u", "v"))
        bound = group if width > 16 else 1 << 62
        signed = _signatures(members, width, cells(sizes.where("n > 2").select("key")))
        several = signed.join(sizes.where(f"n > 2 AND n <= {bound}").select("key"), "key")
        grouped = several.groupBy("key").agg(F.collect_list("fp").alias("fps"))
        found.append(grouped.select("fps").transform(in_arrow, _forest, "u bigint, v bigint"))
        hot = sizes.where(f"n > {bound}").select("key")
        if hot.isEmpty():
            break
        members = signed.join(hot, "key")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, fingerprint and component_id of every row."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select("doc_id", "text_hash", hexed.alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, group: Column) -> DataFrame:
    """One row of every ``group`` of ``found``, with all columns of ``docs``: that of the least id, then of the least text hash.

    Rows equal in both are copies, of which any one stays.
    """
    first = found.groupBy(group.alias("_group")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first"))
    id_text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = first.select(id_text(F.col("_first.doc_id")).alias("_id"), F.col("_first.text_hash").alias("_hash"))
    # The row travels as one column, so that no column of it meets one made here.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), id_text(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_hash"))
    return keyed.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every component, as :func:`first_of_each` picks it. Components without an id are told apart by fingerprint."""
    found = near_duplicates(docs, words)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col("fingerprint")))
    return first_of_each(docs, found, group)
