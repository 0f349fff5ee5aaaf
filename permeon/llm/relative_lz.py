"""Removal of word sequences that occur earlier, by relative Lempel-Ziv parsing.

A window is WINDOW consecutive words of one document. Each word covered by a window
that also starts earlier (in a document with a smaller id, or earlier in the same one)
is removed. Windows that may be equal must meet in one task, so texts are dealt by
content: each window names the first place of the least hash among its GRAM-word
grams, its anchor; equal windows have equal anchors, and the consecutive windows with
one anchor place (at most WINDOW - GRAM + 1) form a piece.

1. Documents are put into groups of about GROUP_BYTES, which send their distinct
   anchors; an anchor with pieces in several groups, or several in one, is shared.
2. Groups send their distinct pieces of shared anchors, each as it occurs first. The
   pieces of a bucket, in the order of their occurrence, are its reference block.
3. The block is indexed: the order of all its suffixes, and for each the neighbours
   in that order that lie earlier in the block. Each piece is parsed from left to
   right into the longest factors that occur earlier. A factor of WINDOW words or
   more is a duplicate span; windows across a factor's end are looked up one by one.
4. Groups remove the spans of first occurrences, and all windows of later ones.

Hashes only deal texts out; pieces and words are told apart by their bytes. An anchor
with over HOT_PIECES different pieces (the edges of a hot passage) has its windows
dealt one by one, by their own hash, so they spread over all buckets.

Defined results: a null text has no words. A null id is later than every other.
Rows with one id but different texts are documents in the order of a hash of their
text; rows equal in both are one document, and each of them gets its result. An
empty table gives no rows. Ids that are not integers are ranked first. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.llm.common import NOT_BLANK, bound_batches, mix, ragged, range_hashes, release_memory, split_words, stored, text_blocks, window_hashes
from permeon.operators.ordering import ranked

WINDOW = 20
GRAM = 6
GROUP_BYTES = 3 << 19
#: Input bytes for each bucket of anchors or pieces.
BUCKET_BYTES = 1 << 20
HOT_PIECES = 64
#: Bytes whose words are split at a time; a longer text is taken whole.
SCAN_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max


class WordTexts:
    """The words of a column of texts: ``flat`` has each word and a blank, ``at`` where words start, ``first`` the documents' words."""

    def __init__(self, texts: pa.Array):
        flat, sizes, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in text_blocks(texts, SCAN_BYTES):
            words = split_words(block.data, block.offsets, NOT_BLANK)
            size = words.ends - words.starts + 1
            # One byte beyond each word is taken along and made a blank.
            here = np.append(block.data, np.uint8(32))[ragged(words.starts, size)]
            here[np.cumsum(size) - 1] = 32
            flat.append(here)
            sizes.append(size)
            counts.append(np.diff(words.first))
        self.flat = np.concatenate(flat)
        self.at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))


class Runs(NamedTuple):
    """Runs of windows with one anchor place: document, first window, number of windows, anchor."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    anchor: np.ndarray


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def anchor_runs(texts: WordTexts, window: int, gram: int) -> Runs:
    """The runs of all texts; places count words from the first one of the column."""
    counts = np.diff(texts.first)
    windows = np.maximum(counts - window + 1, 0)
    if not windows.any():
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))
    h = window_hashes(range_hashes(texts.flat, texts.at[:-1], texts.at[1:] - 1), gram)
    # The place breaks ties among equal hashes: the first one counts.
    bits = np.uint64(max(1, len(h).bit_length()))
    ordered = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_least(ordered, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    start = ragged(texts.first[:-1], windows)
    doc = np.repeat(np.arange(len(windows)), windows)
    place = least[start].astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(head)
    return Runs(doc[heads], start[heads], np.diff(np.append(heads, len(start))), h[place[heads]])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash: sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Pieces(NamedTuple):
    """Pieces by occurrence (start, size, distinct piece) and the distinct ones to send: occurrence and bucket, sorted by bucket."""

    start: np.ndarray
    size: np.ndarray
    which: np.ndarray
    example: np.ndarray
    bucket: np.ndarray


def shared_pieces(texts: WordTexts, order: np.ndarray, codes: np.ndarray, window: int, gram: int, buckets: int) -> Pieces:
    """The pieces of shared anchors, by the codes of the group's sorted distinct anchors.

    ``order`` is the documents' place among those of the group; the first occurrence of a piece is its example.
    """
    runs = anchor_runs(texts, window, gram)
    distinct, place = np.unique(runs.anchor, return_inverse=True)
    if len(distinct) != len(codes):
        raise ValueError("codes do not belong to this group")
    shared = (codes[place] & 1) > 0
    hot = shared & ((codes[place] & 2) > 0)
    plain, single = np.flatnonzero(shared & ~hot), np.flatnonzero(hot)
    start = np.concatenate((runs.start[plain], ragged(runs.start[single], runs.size[single])))
    size = np.concatenate((runs.size[plain], np.ones(len(start) - len(plain), np.int64)))
    doc = np.concatenate((runs.doc[plain], np.repeat(runs.doc[single], runs.size[single])))
    alone = start[len(plain) :]
    key = np.concatenate((runs.anchor[plain], range_hashes(texts.flat, texts.at[alone], texts.at[alone + window]) if len(alone) else runs.anchor[:0]))
    first = np.lexsort((start, order[doc]))
    start, size, key = start[first], size[first], key[first]
    flat, number, which = texts.flat.tobytes(), {}, np.empty(len(start), np.int64)
    begin, end = texts.at[start], texts.at[start + size + window - 1]
    example = []
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        n = number.setdefault(flat[a:b], len(number))
        which[i] = n
        if n == len(example):
            example.append(i)
    example = np.array(example, np.int64)
    bucket = _bucket(key[example], buckets)
    sort = np.lexsort((example, bucket))
    back = np.empty(len(sort), np.int64)
    back[sort] = np.arange(len(sort))
    return Pieces(start, size, back[which] if len(which) else which, example[sort], bucket[sort])


class ReferenceIndex:
    """Index of a block of words (as numbers): the order of all suffixes, and least places over stretches of that order.

    Suffixes are compared over ``longest`` words at least, by ranks over powers of two of words.
    """

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        self.ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while width < longest:
            rank, later = self.ranks[-1], np.zeros(n, np.int64)
            later[: max(0, n - width)] = rank[width:] + 1
            self.ranks.append(np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
            width *= 2
        order = np.lexsort((np.arange(n), self.ranks[-1]))
        self.turn = np.empty(n, np.int64)
        self.turn[order] = np.arange(n)
        self.least = [order.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= n:
            k = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-k], self.least[-1][k:]))

    def earlier(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the nearest suffixes before and after it in the order that start earlier; -1 if none."""
        order, n = self.least[0], len(self.turn)
        low, high = self.turn[at], self.turn[at] + 1
        for k in range(len(self.least) - 1, -1, -1):
            least, step = self.least[k], 1 << k
            fits = low >= step
            low = np.where(fits & (least[np.where(fits, low - step, 0)] > at), low - step, low)
            fits = high + step <= n
            high = np.where(fits & (least[np.where(fits, high, 0)] > at), high + step, high)
        before = np.where(low > 0, order[low - 1], -1)
        return before, np.where(high < n, order[np.minimum(high, n - 1)], -1)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from the places ``a`` and ``b`` on, up to ``most``; a negative ``b`` has none."""
        last, size = len(self.turn) - 1, np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            same = (b >= 0) & (size + (1 << k) <= most) & (rank[np.minimum(a + size, last)] == rank[np.minimum(b + size, last)])
            size[same] += 1 << k
        return size

    def longest_earlier(self, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest match of the words at each place that starts earlier in the block, up to ``most``."""
        before, after = self.earlier(at)
        return np.maximum(self.common(at, before, most), self.common(at, after, most))


def duplicate_windows(words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """For each piece words[bounds[i]:bounds[i + 1]] the bits of its windows that occur earlier in the block.

    All pieces are parsed in step, one factor of each at a time. A separator of its
    own ends each piece, so no match goes on into the next one.
    """
    sizes, pieces = np.diff(bounds), len(bounds) - 1
    bits = np.zeros(pieces, np.uint64)
    if not pieces:
        return bits
    places = bounds[:-1] + np.arange(pieces)
    block = np.empty(len(words) + pieces, np.int64)
    block[ragged(places, sizes)] = words
    block[places + sizes] = words.max(initial=0) + 1 + np.arange(pieces)
    index = ReferenceIndex(block, int(sizes.max()))

    def mark(piece, start, n):
        """Sets ``n`` bits from the window ``start`` on."""
        np.bitwise_or.at(bits, piece, ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)) << start.astype(np.uint64))

    piece = np.flatnonzero(sizes >= window)
    cursor = np.zeros(len(piece), np.int64)
    while len(piece):
        length = index.longest_earlier(places[piece] + cursor, sizes[piece] - cursor)
        long = length >= window
        mark(piece[long], cursor[long], length[long] - window + 1)
        end = cursor + np.maximum(length, 1)
        # The windows that start in this factor and go over its end.
        start = np.maximum(cursor + 1, end - window + 1)
        n = np.maximum(np.minimum(end, sizes[piece] - window + 1) - start, 0)
        at, of = ragged(start, n), np.repeat(piece, n)
        found = index.longest_earlier(places[of] + at, np.full(len(at), window)) >= window
        mark(of[found], at[found], np.ones(int(found.sum()), np.int64))
        more = end <= sizes[piece] - window
        piece, cursor = piece[more], end[more]
    return bits


def word_numbers(flat: bytes) -> np.ndarray:
    """A number for each word of blank-ended words, equal for equal bytes."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in flat.split(b" ")[:-1]], np.int64)


def _column(table: pa.Table, name: str):
    chunks = table.column(name).combine_chunks()
    return pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks


def _packed(*arrays) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0


def _distinct_documents(docs: DataFrame) -> DataFrame:
    """_id, _late (null ids and the hash of texts), _text and _copies, one row for each document.

    Texts are grouped only where some id stands in several rows.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    else:
        # Null ids are not joined: they get the last place below.
        ids = stored(ranked(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), ["doc_id"], name="_id"), "ids")
        rows = rows.join(ids, "doc_id", "left").withColumn("_id", F.coalesce(F.col("_id").cast("long"), F.lit(NO_ID)))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count()
    if not repeated:
        return rows.withColumns({"_late": F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"), "_copies": F.lit(1).cast("long")})
    late = F.shiftrightunsigned(F.xxhash64("_text"), 2) + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    return rows.groupBy("doc_id", "_id", "_text").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_late", late)


def _order(table: pa.Table) -> np.ndarray:
    """Place of every document of a group in the order of documents."""
    order = np.lexsort((_column(table, "_late").to_numpy(), _column(table, "_id").to_numpy()))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def remove_duplicate_windows(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and number of words of each removed run) and kept of every row.

    ``kept`` are the words that stay, joined by one blank.
    """
    if not 0 < gram <= window or window - gram >= 64:
        raise ValueError("a window must hold 1 to 64 grams")
    bound_batches(docs.sparkSession)
    docs = _distinct_documents(docs)
    total = _total_bytes(docs)
    groups, buckets = max(32, -(-total // group_bytes)), max(32, -(-total // bucket_bytes))
    by_group = docs.withColumn("_group", F.pmod(F.xxhash64("_id", "_text"), F.lit(groups))).groupBy("_group")

    def send_anchors(key, table):
        texts = WordTexts(_column(table, "_text"))
        runs = anchor_runs(texts, window, gram)
        hashes = range_hashes(texts.flat, texts.at[runs.start], texts.at[runs.start + runs.size + window - 1]) if len(runs.start) else runs.anchor
        order = np.lexsort((hashes, runs.anchor))
        anchor, text = runs.anchor[order], hashes[order]
        heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        fresh = np.ones(len(anchor), np.int64)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        several = np.diff(np.append(heads, len(anchor))) > 1
        pieces = np.add.reduceat(fresh, heads) if len(heads) else heads
        anchors = anchor[heads]
        names, cuts = np.unique(_bucket(anchors, buckets), return_index=True)
        ends = np.append(cuts, len(anchors))[1:]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())
        # 1: one place; 2: several places of one piece; above: the number of different pieces, and one.
        kinds = np.where(pieces > 1, np.minimum(pieces + 1, 255), 1 + several).astype(np.uint8)
        low = (anchors & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({
            "bucket": pa.array(names, pa.int64()), "_group": pa.array([key[0].as_py()] * len(names), pa.int64()),
            "anchors": cut(low), "kinds": cut(kinds), "marks": cut((text[heads] & np.uint64(255)).astype(np.uint8)),
        })

    def share_anchors(key, table):
        rows = [np.frombuffer(x, np.uint32) for x in table.column("anchors").to_pylist()]
        kinds, marks = (np.concatenate([np.frombuffer(x, np.uint8) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("kinds", "marks"))
        distinct, place, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        shared = (seen > 1) | (np.bincount(place, weights=kinds > 1) > 0)
        # Groups with one piece differ if its mark does; those with several count in full.
        single = np.unique((place * 256 + marks)[kinds < 3]) // 256
        different = np.bincount(single, minlength=len(distinct)) + np.bincount(place, weights=np.where(kinds < 3, 0, kinds - 1))
        code = shared.astype(np.uint8) + 2 * (different > hot_pieces).astype(np.uint8)
        answers = np.split(code[place], np.cumsum([len(r) for r in rows])[:-1])
        return pa.table({
            "kind": pa.array([0] * len(rows), pa.int32()), "_group": table.column("_group"), "bucket": table.column("bucket"),
            "payload": pa.array([a.tobytes() for a in answers], pa.binary()),
        })

    def pieces_of(table, known):
        texts = WordTexts(_column(table, "_text"))
        codes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in _payloads(known, 0))])
        return texts, shared_pieces(texts, _order(table), codes, window, gram, buckets)

    def send_pieces(key, table, known):
        texts, pieces = pieces_of(table, known)
        start, size = pieces.start[pieces.example], pieces.size[pieces.example]
        doc = np.searchsorted(texts.first, start, "right") - 1
        ids, late = (_column(table, c).to_numpy()[doc] for c in ("_id", "_late"))
        inside = (start - texts.first[doc]).astype(np.int32)
        begin, end = texts.at[start], texts.at[start + size + window - 1]
        flat = texts.flat.tobytes()
        names, cuts = np.unique(pieces.bucket, return_index=True)
        messages = []
        for a, b in zip(cuts.tolist(), np.append(cuts, len(start))[1:].tolist(), strict=True):
            text = b"".join(flat[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True))
            messages.append(_packed(ids[a:b], late[a:b], inside[a:b], size[a:b].astype(np.uint8), np.frombuffer(text, np.uint8)))
        n = np.diff(np.append(cuts, len(start)))
        release_memory()
        return pa.table({
            "bucket": pa.array(names, pa.int64()), "_group": pa.array([key[0].as_py()] * len(names), pa.int64()),
            "n": pa.array(n, pa.int64()), "message": pa.array(messages, pa.binary()),
        })

    def parse_pieces(key, table):
        counts = table.column("n").to_pylist()
        parts = []
        for n, packed in zip(counts, table.column("message").to_pylist(), strict=True):
            raw = _unpacked(packed)
            arrays = [np.frombuffer(raw, t, n, at) for t, at in ((np.int64, 0), (np.int64, 8 * n), (np.int32, 16 * n), (np.uint8, 20 * n))]
            parts.append((*arrays, word_bounds(raw[21 * n :], arrays[3].astype(np.int64) + window - 1)))
        ids, late, inside, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        texts = [t for p in parts for t in p[4]]
        order = np.lexsort((inside, late, ids))
        first, chosen, later = {}, [], np.zeros(len(order), bool)
        for i in order.tolist():
            if texts[i] in first:
                later[i] = True
            else:
                first[texts[i]] = i
                chosen.append(i)
        chosen = np.array(chosen, np.int64)
        numbers = word_numbers(b"".join(texts[i] for i in chosen.tolist()))
        lengths = sizes[chosen].astype(np.int64) + window - 1
        bits = np.empty(len(order), np.uint64)
        bits[chosen] = duplicate_windows(numbers, np.concatenate(([0], np.cumsum(lengths))), window)
        bits[later] = (np.uint64(1) << sizes[later].astype(np.uint64)) - np.uint64(1)
        answers = np.split(bits, np.cumsum(counts)[:-1])
        release_memory()
        return pa.table({
            "kind": pa.array([1] * len(counts), pa.int32()), "_group": table.column("_group"), "bucket": table.column("bucket"),
            "payload": pa.array([_packed(a) for a in answers], pa.binary()),
        })

    def report(key, table, known):
        texts, pieces = pieces_of(table, known)
        bits = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(_unpacked(x), np.uint64) for x in _payloads(known, 1))])
        own = bits[pieces.which] if len(pieces.which) else bits
        later = np.ones(len(pieces.start), bool)
        later[pieces.example] = False
        own = np.where(later, (np.uint64(1) << pieces.size.astype(np.uint64)) - np.uint64(1), own)
        depth = np.zeros(len(texts.at) + 1, np.int64)
        for k in range(int(pieces.size.max(initial=0))):
            at = pieces.start[(own >> np.uint64(k) & np.uint64(1)) > 0] + k
            np.add.at(depth, at, 1)
            np.add.at(depth, at + window, -1)
        gone = np.cumsum(depth)[: len(texts.at) - 1] > 0
        return _report(table, texts, gone)

    head = "kind int, _group bigint, bucket bigint, payload binary"
    anchors = by_group.applyInArrow(send_anchors, "bucket bigint, _group bigint, anchors binary, kinds binary, marks binary")
    codes = anchors.groupBy("bucket").applyInArrow(share_anchors, head)
    sent = by_group.cogroup(codes.groupBy("_group")).applyInArrow(send_pieces, "bucket bigint, _group bigint, n bigint, message binary")
    answers = sent.groupBy("bucket").applyInArrow(parse_pieces, head)
    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = f"doc_id {key.dataType.simpleString()}, n_words bigint, n_removed bigint, spans array<struct<first:bigint,words:bigint>>, kept string, _copies bigint"
    out = by_group.cogroup(codes.union(answers).groupBy("_group")).applyInArrow(report, schema)
    each = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return out.select("doc_id", "n_words", "n_removed", "spans", "kept", "_copies", each.alias("_copy")).drop("_copies", "_copy")


def word_bounds(flat: bytes, sizes: np.ndarray) -> list[bytes]:
    """Blank-ended words cut into texts of the given numbers of words."""
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    ends = (blanks[np.cumsum(sizes) - 1] + 1).tolist() if len(sizes) else []
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _payloads(known: pa.Table, kind: int) -> list[bytes]:
    """Payloads of one kind in the order of their buckets."""
    return known.filter(pc.equal(known.column("kind"), kind)).sort_by("bucket").column("payload").to_pylist()


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def _report(table: pa.Table, texts: WordTexts, gone: np.ndarray) -> pa.Table:
    upto = np.concatenate(([0], np.cumsum(gone)))
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    edges = texts.first[:-1][texts.first[:-1] < len(gone)]
    start[edges] = gone[edges]
    starts = np.flatnonzero(start)
    stop = ~gone | start
    # A run ends before the next word that stays or starts a run itself.
    after = np.append(np.flatnonzero(stop), len(gone))
    ends = after[np.searchsorted(after, starts, "right")]
    per_doc = np.searchsorted(starts, texts.first)
    doc = np.repeat(np.arange(len(texts.first) - 1), np.diff(per_doc))
    values = pa.StructArray.from_arrays([pa.array(starts - texts.first[doc]), pa.array(ends - starts)], ["first", "words"])
    stays = np.repeat(~gone, np.diff(texts.at))
    flat = texts.flat[stays]
    cut = np.concatenate(([0], np.cumsum(stays)))[texts.at[texts.first]]
    # The blank after the last word goes.
    kept = [flat[a : max(a, b - 1)].tobytes().decode("utf-8") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    release_memory()
    return pa.table({
        "doc_id": _column(table, "doc_id"), "n_words": np.diff(texts.first), "n_removed": np.diff(upto[texts.first]),
        "spans": pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), values).cast(_SPANS), "kept": pa.array(kept, pa.string()), "_copies": _column(table, "_copies"),
    })
