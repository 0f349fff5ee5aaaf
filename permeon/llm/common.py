"""Shared pieces: stored intermediates, seeded folds, and word arithmetic over Arrow buffers.

The array functions work on blocks of whole texts (:func:`text_blocks`): one byte
array and the offsets of its documents. Words, hashes and windows are then found
for all documents of a block in a few passes, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.session import BATCH_BYTES, bound_batches, in_arrow, release_memory, scratch_dir  # noqa: F401

#: Bytes of text that one block aims at; a longer document is a block by itself.
BLOCK_BYTES = 1 << 19
#: Odd multipliers of the polynomial hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_WRAP = 1 << 64
_BASE_INVERSE = pow(BYTE_BASE, -1, _WRAP)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again: lineage ends there."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Block(NamedTuple):
    """Rows ``first`` to ``last`` of a batch; document i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def byte_class(chars: bytes, rest: bool) -> np.ndarray:
    """256 flags: ``not rest`` for the given bytes, ``rest`` for all others."""
    flags = np.full(256, rest)
    flags[list(chars)] = not rest
    return flags


#: Word bytes of [^\x20\x09-\x0D]+ .
NOT_BLANK = byte_class(b" \t\n\x0b\x0c\r", rest=True)
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
WORD_BYTES = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)), rest=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Byte ranges of the words; document i has words first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes flagged by ``inside``; a run ends with its document."""
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(flags[1:] & (cut | ~flags[:-1]))
    ends = np.flatnonzero(flags[:-1] & (cut | ~flags[1:]))
    return Words(starts, ends, np.searchsorted(starts, offsets))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every range, equal for equal bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by place of the first."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(WORD_BASE)
        out += h[i : i + n]
    return mix(out)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+sizes[0]-1, starts[1] .. and so on, in one array."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return places
