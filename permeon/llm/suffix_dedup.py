"""Removal of byte strings that an earlier document has, by suffix arrays.

A string of LENGTH bytes is removed from a document if it also starts in a document
with a smaller id. Suffixes that may be equal must meet in one task, so they are
dealt by content: every LENGTH-byte window names the least hash of the short grams
in it, its anchor; equal windows have equal anchors, and consecutive windows mostly
share one, so a text falls into pieces of a few windows each.

1. Documents are put into groups of about GROUP_BYTES. Every group sends its
   distinct anchors; an anchor that several groups have is shared.
2. Groups send the distinct pieces of shared anchors, each with its least document.
3. The pieces of an anchor are cut again by longer grams (LONG_GRAM), and the distinct
   cuts of one long anchor become one generalised suffix array, made by linear grouping
   (:mod:`permeon.llm.suffix_array`); neighbours in it that agree in LENGTH bytes
   are one string, whose least document is sent back. An anchor with one piece
   has nothing to sort, nor has a long anchor with one cut.
4. Groups remove what is known from an earlier document.

All messages are packed arrays, one row per group and bucket. A hot passage is sent
once per group, however often it occurs there. An anchor with over HOT_PIECES
different pieces (the surroundings of a hot passage) is dealt again by the bytes that
SLOT adjacent windows share, so its pieces spread over all buckets.

Defined results: a null text is empty. A null id is later than every other (the
greatest long counts as null), and never earlier than any. Ids that are not integers
are ranked first. Rows with one id never remove from each other. Bytes are
bytes: a cut may fall inside a character. Columns other than those named are not
read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.llm.common import bound_batches, mix, ragged, range_hashes, stored, text_blocks
from permeon.llm.suffix_array import suffix_arrays
from permeon.operators.ordering import ranked

LENGTH = 50
GRAM = 16
LONG_GRAM = 32
GROUP_BYTES = 3 << 19
#: Input bytes for each bucket of anchors or pieces; a bucket's pieces have up to four times as many.
BUCKET_BYTES = 4 << 20
PIECE_WINDOWS = 64
#: Bytes whose grams are hashed at a time; a longer text is taken whole.
SCAN_BYTES = 1 << 16
HOT_PIECES = 64
SLOT = 4
#: Symbols that one call of the suffix sorter takes.
BATCH_SYMBOLS = 1 << 18
NO_ID = np.iinfo(np.int64).max


class Runs(NamedTuple):
    """Maximal runs of windows with one anchor: document, first window, number of windows, anchor."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    anchor: np.ndarray


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive bytes, n a power of two."""
    h, k, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while k < n:
        h = h[:-k] * np.uint64(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    return mix(h)


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def _runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of some texts that lie one after another."""
    least = _sliding_least(_grams(data, gram), length - gram + 1)
    head = np.ones(len(least) + 1, bool)
    head[1:-1] = least[1:] != least[:-1]
    ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    for edge in (offsets[:-1], ends):
        head[edge[edge < len(least)]] = True
    heads = np.flatnonzero(head)
    start, size = heads[:-1], np.diff(heads)
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start < ends[doc]
    start = start[inside]
    # Least hashes are small numbers; mixed they spread over all buckets.
    return Runs(doc[inside], start, size[inside], mix(least[start]))


def _joined_runs(blocks, length: int, gram: int) -> Runs:
    """The runs of (texts' bytes, offsets), block after block; places count from the first byte of all."""
    found, at, row = [], 0, 0
    for data, offsets in blocks:
        if (np.diff(offsets) >= length).any():
            runs = _runs_of(data, offsets, length, gram)
            found.append(runs._replace(doc=runs.doc + row, start=runs.start + at))
        at, row = at + len(data), row + len(offsets) - 1
    if not found:
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def anchor_runs(texts: pa.Array, length: int) -> Runs:
    """The runs of all texts; places count from the first byte of the column."""
    return _joined_runs(((block.data, block.offsets) for block in text_blocks(texts, SCAN_BYTES)), length, GRAM)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and the offsets of its texts."""
    blocks = list(text_blocks(texts, 1 << 62))
    return (blocks[0].data, blocks[0].offsets) if blocks else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash: sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first one first), and where in it each distinct combination starts."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(change)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each entry its distinct combination of the keys, an example of each, and what :func:`_first_of_equal` gives."""
    order, heads = _first_of_equal(*keys)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return which, order[heads], heads, order


def _split_runs(runs: Runs, which: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(run, first window, windows) of the chosen runs, cut after every ``size`` windows."""
    parts = -(-runs.size[which] // size)
    run = np.repeat(which, parts)
    step = ragged(np.zeros(len(which), np.int64), parts) * size
    return run, runs.start[run] + step, np.minimum(runs.size[run] - step, size)


def _slots(runs: Runs, which: np.ndarray, data: np.ndarray, length: int):
    """Pieces of hot anchors: (run, first window, windows, key).

    A window's slot is its distance to its first anchor gram, divided by SLOT, so
    equal windows have equal slots. Windows of a slot share all but SLOT - 1 bytes
    at either end; that core goes into the key.
    """
    run = np.repeat(which, runs.size[which])
    window = ragged(runs.start[which], runs.size[which])
    sizes = runs.size[which] + length - 1
    distances = [np.zeros(0, np.int64)]
    for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(sizes) // SCAN_BYTES)) + 1):
        if not len(part):
            continue
        laid, grams = sizes[part], sizes[part] - GRAM + 1
        hashes = mix(_grams(data[ragged(runs.start[which[part]], laid)], GRAM))[ragged(np.cumsum(laid) - laid, grams)]
        # Every window has its run's anchor among its grams.
        anchors = np.flatnonzero(hashes == np.repeat(runs.anchor[which[part]], grams))
        first = ragged(np.cumsum(grams) - grams, runs.size[which[part]])
        distances.append(anchors[np.searchsorted(anchors, first)] - first)
    distance = np.concatenate(distances)
    slot = distance // SLOT
    head = np.ones(len(window), bool)
    head[1:] = (run[1:] != run[:-1]) | (slot[1:] != slot[:-1]) | (distance[1:] != distance[:-1] - 1)
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(window)))
    gram = window[heads] + distance[heads]
    core = gram - slot[heads] * SLOT
    key = mix(runs.anchor[run[heads]] ^ mix(range_hashes(data, core, core + length - SLOT + 1) + slot[heads].astype(np.uint64)))
    return run[heads], window[heads], size, key


class Pieces(NamedTuple):
    """Pieces of a group by occurrence, and the distinct ones (by key, then text) they belong to."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    which: np.ndarray
    key: np.ndarray
    example: np.ndarray
    least: np.ndarray


def shared_pieces(texts: pa.Array, ids: np.ndarray, codes: np.ndarray, length: int) -> Pieces:
    """The pieces of a group whose anchors are shared, or hot, by the codes of its sorted distinct anchors."""
    data, _ = _bytes_of(texts)
    runs = anchor_runs(texts, length)
    distinct, place = np.unique(runs.anchor, return_inverse=True)
    if len(distinct) != len(codes):
        raise ValueError("codes do not belong to this group")
    low, high = np.full(len(distinct), len(ids)), np.full(len(distinct), -1)
    np.minimum.at(low, place, runs.doc)
    np.maximum.at(high, place, runs.doc)
    shared = ((codes & 1) > 0) | (low != high)
    hot = (codes & 2) > 0
    run, start, size = _split_runs(runs, np.flatnonzero((shared & ~hot)[place]), PIECE_WINDOWS)
    key = runs.anchor[run]
    hot_runs = np.flatnonzero((shared & hot)[place])
    if len(hot_runs):
        more = _slots(runs, hot_runs, data, length)
        run, start, size, key = (np.concatenate(x) for x in zip((run, start, size, key), more, strict=True))
    text = range_hashes(data, start, start + size + length - 1) if len(start) else np.zeros(0, np.uint64)
    which, example, heads, order = _distinct(key, text)
    doc = runs.doc[run]
    least = np.minimum.reduceat(ids[doc][order], heads) if len(heads) else np.zeros(0, np.int64)
    return Pieces(doc, start, size, which, key[example], example, least)


def least_documents(data: np.ndarray, bounds: np.ndarray, key: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each window of each distinct piece, one after another, the least document that has it.

    Piece i is data[bounds[i]:bounds[i + 1]]; pieces are sorted by key. Windows of
    different keys are not compared. Pieces of a key are cut where the least long gram
    of their windows changes, so strings to sort are short and hold what may be equal.
    """
    if length < LONG_GRAM + 8 or not len(key):
        return _sorted_least(data, bounds, key, least, length)
    sizes = np.diff(bounds)
    windows = sizes - length + 1
    out = np.repeat(least, windows)
    new = key[1:] != key[:-1]
    several = np.flatnonzero(~(np.append(True, new) & np.append(new, True)))
    if not len(several):
        return out
    text = data[ragged(bounds[several], sizes[several])]
    laid = np.concatenate(([0], np.cumsum(sizes[several])))
    cuts = np.append(np.searchsorted(laid, np.arange(0, laid[-1], SCAN_BYTES)), len(several))
    blocks = ((text[laid[a] : laid[b]], laid[a : b + 1] - laid[a]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if a < b)
    runs = _joined_runs(blocks, length, LONG_GRAM)
    finer = mix(runs.anchor ^ mix(key[several].astype(np.uint64))[runs.doc])
    which, example, heads, order = _distinct(finer, range_hashes(text, runs.start, runs.start + runs.size + length - 1))
    own = np.concatenate(([0], np.cumsum(runs.size[example] + length - 1)))
    earliest = np.minimum.reduceat(least[several][runs.doc][order], heads)
    values = _sorted_least(text[ragged(runs.start[example], np.diff(own))], own, finer[example], earliest, length)
    begin = np.cumsum(windows) - windows
    first = np.cumsum(runs.size[example]) - runs.size[example]
    place = begin[several][runs.doc] + runs.start - laid[runs.doc]
    out[ragged(place, runs.size)] = values[ragged(first[which], runs.size)]
    return out


def _sorted_least(data: np.ndarray, bounds: np.ndarray, key: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """What :func:`least_documents` returns, by one suffix array for each key."""
    sizes = np.diff(bounds)
    windows = sizes - length + 1
    out = np.repeat(least, windows)
    begin = np.cumsum(windows) - windows
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    pieces = np.diff(np.append(heads, len(key)))
    symbols = np.add.reduceat(sizes + 1, heads) if len(heads) else np.zeros(0, np.int64)
    several = np.flatnonzero(pieces > 1)
    several = several[np.argsort(symbols[several], kind="stable")]
    total = np.cumsum(symbols[several])
    at = 0
    while at < len(several):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_SYMBOLS, "right")))
        chosen = several[at:upto]
        at = upto
        piece = ragged(heads[chosen], pieces[chosen])
        laid = np.concatenate(([0], np.cumsum(sizes[piece] + 1)))
        text = np.zeros(laid[-1] + 8, np.int64)
        text[ragged(laid[:-1], sizes[piece])] = data[ragged(bounds[piece], sizes[piece])].astype(np.int64) + 1
        strings = np.concatenate(([0], np.cumsum(symbols[chosen])))
        order = suffix_arrays(text[:-8], strings)
        # Windows only, in suffix order, with the place of each in ``out`` and its string.
        slot = np.full(laid[-1], -1)
        slot[ragged(laid[:-1], windows[piece])] = ragged(begin[piece], windows[piece])
        order = order[slot[order] >= 0]
        string = np.searchsorted(strings, order, "right")
        packed, raw = np.zeros(len(text) - 8, np.uint64), text.astype(np.uint64)
        for i in range(8):  # symbols reach 256 only for byte 255, which UTF-8 never has
            packed |= (raw[i : i + len(packed)] & np.uint64(255)) << np.uint64(8 * i)
        same = string[1:] == string[:-1]
        for step in [*range(0, length - 7, 8), length - 8]:
            same &= packed[np.minimum(order[1:] + step, len(packed) - 1)] == packed[np.minimum(order[:-1] + step, len(packed) - 1)]
        runs = np.flatnonzero(np.concatenate(([True], ~same)))
        values = np.minimum.reduceat(out[slot[order]], runs)
        out[slot[order]] = np.repeat(values, np.diff(np.append(runs, len(order))))
    return out


def _column(table: pa.Table, name: str):
    chunks = table.column(name).combine_chunks()
    return pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(_column(table, "_id"), NO_ID).to_numpy(zero_copy_only=False)


def _binary(parts) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _messages(group: int, kind: int, buckets: np.ndarray, **arrays) -> pa.Table:
    """One row per bucket; every array is cut where the (sorted) bucket of its entries changes.

    Of an array with offsets the entries' stretches are cut, and compressed.
    """
    names, cuts = np.unique(buckets, return_index=True)
    ends = np.append(cuts, len(buckets))[1:]
    columns = {"kind": pa.array(np.full(len(names), kind), pa.int32()), "bucket": pa.array(names, pa.int64()), "_group": pa.array(np.full(len(names), group), pa.int64())}
    for name, (values, offsets) in arrays.items():
        places = cuts if offsets is None else offsets[cuts]
        stops = ends if offsets is None else offsets[ends]
        parts = (values[a:b].tobytes() for a, b in zip(places.tolist(), stops.tolist(), strict=True))
        columns[name] = pa.array([p if offsets is None else pa.compress(p, "zstd", asbytes=True) for p in parts], pa.binary())
    return pa.table(columns)


def _total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0


def _removal(docs: DataFrame, length: int, group_bytes: int, bucket_bytes: int, hot_pieces: int):
    """The documents by group, and what each group gets to know, as packed rows."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    bound_batches(docs.sparkSession)
    total = _total_bytes(docs)
    groups, buckets = max(32, -(-total // group_bytes)), max(32, -(-total // bucket_bytes))
    deal = F.pmod(F.xxhash64("_id", "_text"), F.lit(groups))
    docs = docs.withColumn("_group", deal)
    by_group = docs.groupBy("_group")

    def send_anchors(key, table):
        texts = _column(table, "_text")
        runs = anchor_runs(texts, length)
        data, _ = _bytes_of(texts)
        hashes = range_hashes(data, runs.start, runs.start + runs.size + length - 1) if len(runs.start) else np.zeros(0, np.uint64)
        anchors, place, n = np.unique(runs.anchor, return_inverse=True, return_counts=True)
        least = np.empty(len(anchors), np.uint64)
        least[place] = hashes
        again = np.flatnonzero(n[place] > 1)
        order, heads = _first_of_equal(place[again], hashes[again])
        several, first, pieces = np.unique(place[again][order[heads]], return_index=True, return_counts=True)
        least[several], n[several] = hashes[again][order[heads]][first], pieces
        low = (anchors & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        marks = (least & np.uint64(255)).astype(np.uint8)
        return _messages(key[0].as_py(), 0, _bucket(anchors, buckets), anchors=(low, None), pieces=(np.minimum(n, 255).astype(np.uint8), None), marks=(marks, None))

    def share_anchors(key, table):
        rows = [np.frombuffer(x, np.uint32) for x in table.column("anchors").to_pylist()]
        n, marks = (np.concatenate([np.frombuffer(x, np.uint8) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("pieces", "marks"))
        distinct, place, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        # Groups with one piece have different ones if its mark differs; those with several count in full.
        alone = seen[place] == 1
        single = np.unique((place * 256 + marks)[(n == 1) & ~alone]) // 256
        different = np.bincount(single, minlength=len(distinct)) + np.bincount(place, weights=np.where((n > 1) | alone, n, 0), minlength=len(distinct))
        code = (seen > 1).astype(np.uint8) + 2 * (different > hot_pieces).astype(np.uint8)
        cuts = np.cumsum([len(r) for r in rows])[:-1]
        answers = np.split(code[place], cuts)
        return pa.table({"kind": pa.array(np.zeros(len(rows)), pa.int32()), "_group": table.column("_group"), "bucket": table.column("bucket"), "payload": _binary(answers)})

    def codes_of(table: pa.Table) -> np.ndarray:
        return _payloads(table, 0, np.uint8)

    def send_pieces(key, table, known):
        texts, ids = _column(table, "_text"), _ids(table)
        pieces = shared_pieces(texts, ids, codes_of(known), length)
        data, _ = _bytes_of(texts)
        start, size = pieces.start[pieces.example], pieces.size[pieces.example] + length - 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        low = (pieces.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _messages(
            key[0].as_py(), 1, _bucket(pieces.key, buckets),
            keys=(low, None), least=(pieces.least, None), sizes=(size.astype(np.uint8), None), text=(data[ragged(start, size)], offsets),
        )

    def compare_pieces(key, table):
        def joined(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

        low, least, sizes = joined("keys", np.uint32), joined("least", np.int64), joined("sizes", np.uint8).astype(np.int64)
        packed = zip(table.column("text").to_pylist(), table.column("sizes").to_pylist(), strict=True)
        texts = [pa.decompress(t, int(np.frombuffer(n, np.uint8).sum(dtype=np.int64)), "zstd", asbytes=True) for t, n in packed]
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        which, example, heads, order = _distinct(low, range_hashes(data, bounds[:-1], bounds[1:]))
        own = np.concatenate(([0], np.cumsum(sizes[example])))
        values = least_documents(data[ragged(bounds[example], sizes[example])], own, low[example], np.minimum.reduceat(least[order], heads), length)
        # Back in the senders' order, as runs of windows with one least document.
        windows = sizes - length + 1
        begin = np.cumsum(sizes[example] - length + 1) - (sizes[example] - length + 1)
        flat = values[ragged(begin[which], windows)]
        starts = np.cumsum(windows) - windows
        change = np.zeros(len(flat), bool)
        change[1:] = flat[1:] != flat[:-1]
        change[starts] = True
        runs = np.flatnonzero(change)
        run_sizes = np.diff(np.append(runs, len(flat))).astype(np.uint8)
        per_piece = np.diff(np.searchsorted(runs, np.append(starts, len(flat))))
        answers, piece, run = [], 0, 0
        for raw in table.column("keys").to_pylist():
            n = len(raw) // 4
            k = int(per_piece[piece : piece + n].sum())
            answers.append(np.array([n], "<i8").tobytes() + per_piece[piece : piece + n].astype(np.uint8).tobytes() + run_sizes[run : run + k].tobytes() + flat[runs[run : run + k]].tobytes())
            piece, run = piece + n, run + k
        return pa.table({"kind": pa.array(np.ones(len(answers)), pa.int32()), "_group": table.column("_group"), "bucket": table.column("bucket"), "payload": pa.array(answers, pa.binary())})

    head = "kind int, _group bigint, bucket bigint"
    anchors = by_group.applyInArrow(send_anchors, "kind int, bucket bigint, _group bigint, anchors binary, pieces binary, marks binary")
    codes = anchors.groupBy("bucket").applyInArrow(share_anchors, f"{head}, payload binary")
    pieces = by_group.cogroup(codes.groupBy("_group")).applyInArrow(
        send_pieces, "kind int, bucket bigint, _group bigint, keys binary, least binary, sizes binary, text binary"
    )
    answers = pieces.groupBy("bucket").applyInArrow(compare_pieces, f"{head}, payload binary")
    return by_group, codes.union(answers).groupBy("_group")


def _payloads(known: pa.Table, kind: int, dtype=None):
    """Payloads of one kind in the order of their buckets."""
    rows = known.filter(pc.equal(known.column("kind"), kind)).sort_by("bucket").column("payload").to_pylist()
    return rows if dtype is None else np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for x in rows)])


def removed_bytes(texts: pa.Array, ids: np.ndarray, known: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a group's texts, the texts' offsets, and which bytes go."""
    pieces = shared_pieces(texts, ids, _payloads(known, 0, np.uint8), length)
    counts, sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for raw in _payloads(known, 1):
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        counts.append(np.frombuffer(raw, np.uint8, n, 8).astype(np.int64))
        k = int(counts[-1].sum())
        sizes.append(np.frombuffer(raw, np.uint8, k, 8 + n).astype(np.int64))
        values.append(np.frombuffer(raw[8 + n + k :], np.int64))
    counts, sizes, values = (np.concatenate(x) for x in (counts, sizes, values))
    first = np.cumsum(counts) - counts
    before = np.cumsum(sizes) - sizes
    which = pieces.which
    run = ragged(first[which], counts[which])
    of = np.repeat(np.arange(len(which)), counts[which])
    begin = pieces.start[of] + before[run] - before[first[which]][of]
    early = values[run] < ids[pieces.doc[of]]
    data, offsets = _bytes_of(texts)
    depth = np.bincount(begin[early], minlength=len(data) + 1) - np.bincount((begin + sizes[run] - 1 + length)[early], minlength=len(data) + 1)
    return data, offsets, np.cumsum(depth[: len(data)]) > 0


def _prepared(docs: DataFrame, *more) -> DataFrame:
    """_id, _text and ``more``. Ids that are not integers are replaced by their ranks; null stays null."""
    kind, text = docs.schema["doc_id"].dataType, F.coalesce("text", F.lit("")).alias("_text")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs.select(F.col("doc_id").cast("long").alias("_id"), text, *more)
    ids = docs.select(F.col("doc_id").alias("_key")).where("_key IS NOT NULL").distinct()
    ids = stored(ranked(ids, ["_key"], name="_id"), "ids")
    rows = docs.select(F.col("doc_id").alias("_key"), text, *more)
    return rows.join(ids, "_key", "left").select(F.col("_id").cast("long").alias("_id"), "_text", *(c for c in rows.columns[2:]))


def removal_report(
    docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    by_group, known = _removal(_prepared(docs, F.col("doc_id").alias("_own")), length, group_bytes, bucket_bytes, hot_pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(key, table, known):
        data, offsets, gone = removed_bytes(_column(table, "_text"), _ids(table), known, length)
        upto = np.concatenate(([0], np.cumsum(gone)))
        inner = gone.copy()
        inner[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(gone)]
        inner[edge] = gone[edge]
        spans = np.concatenate(([0], np.cumsum(inner)))
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table({"doc_id": _column(table, "_own"), "n_bytes": np.diff(offsets), "n_removed": np.diff(upto[offsets]), "n_spans": np.diff(spans[offsets]), "kept_sha256": pa.array(kept, pa.string())})

    return by_group.cogroup(known).applyInArrow(report, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """All rows and columns of ``docs`` with what stays of each text; ``n_chars``, where there is one, follows.

    Characters that a cut has split are dropped. A text that had nothing removed is
    returned as it was, null included.
    """
    rest = F.struct(*(c for c in docs.columns if c != "text"))
    rows = _prepared(docs, rest.alias("_row"), F.col("text").isNull().alias("_null"))
    by_group, known = _removal(rows, length, group_bytes, bucket_bytes, hot_pieces)
    schema = T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType()), T.StructField("_null", T.BooleanType())])

    def rewrite(key, table, known):
        data, offsets, gone = removed_bytes(_column(table, "_text"), _ids(table), known, length)
        kept = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table({"_row": _column(table, "_row"), "_kept": pa.array(kept, pa.string()), "_null": _column(table, "_null")})

    out = by_group.cogroup(known).applyInArrow(rewrite, schema)
    text = F.when(~F.col("_null"), F.col("_kept"))
    values = {c: F.col("_row").getField(c) for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), values["n_chars"])
    return out.select(*(values[c].alias(c) for c in docs.columns))
