"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two, at most
``length``: whole sequences first, then the binary digits of the rest. Every piece
is a sequence of its own, pieces of equal length form a bucket, and so no sequence
crosses documents and none needs padding.

One narrow pass: nothing is shuffled. Each whole text is encoded by itself and
nothing is remembered between texts, so a worker's memory does not grow.

Defined results: a null text is empty and has one token, the end id. Rows are packed one by
one: repeated rows get sequences of their own, null ids stay null. An empty table gives no
rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from permeon.llm.common import in_arrow, text_blocks

LENGTH = 2048
END_ID = 1
#: Fixed value: how byte-level BPE splits a text before it merges (letters, digits, the rest, blanks).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if the tokenizer is plain byte-level BPE whose ids follow the order of its merges; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocabulary, letters = model["vocab"], byte_letters()
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocabulary[t] for t in made]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    try:
        return {bytes(letters[c] for c in t): vocabulary[t] for t in [*letters, *made]}
    except KeyError:
        return None


class Encoder:
    """Token ids of texts, as the tokenizer file gives them.

    Plain byte-level vocabularies are encoded by tiktoken, which is several times
    faster on one core. Texts that hold one of the added tokens, and other
    vocabularies, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer would run beside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.tokenizer = path, None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = merge_ranks(spec)
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it lives on from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Whole sequences, then the binary digits of the rest, longest first."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents.

    Columns: doc_id, start, length, ids (if asked for), ids_crc32 (of the little-endian
    unsigned 32-bit ids), doc_tokens, sequence_id, offset and bucket, the
    logarithm of the length. Write it partitioned by ``bucket`` to have one set
    of files per length. ``sequence_id`` is Spark's row number by partition, as
    the plan has no shuffle after it a retried task gives the same.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("text").alias("_text"), "doc_id")
    key = rows.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        encode = encoder(path).encode
        for batch in batches:
            keys = batch.column(1)
            for block in text_blocks(batch.column(0)):
                raw, bounds = block.data.tobytes(), block.offsets.tolist()
                row, start, size, crc, tokens, own = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    whole = np.append(encode(raw[a:b].decode("utf-8")), np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for n in piece_lengths(len(whole), length):
                        part = whole[at : at + n]
                        row.append(block.first + i)
                        start.append(at)
                        size.append(n)
                        crc.append(zlib.crc32(part))
                        tokens.append(len(whole))
                        if with_ids:
                            own.append(part)
                        at += n
                columns = [keys.take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, size, crc, tokens)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    names.append("ids")
                    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                    values = np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    cut = rows.transform(in_arrow, pieces, schema)
    return cut.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2(F.col("length").cast("double")).cast("int")}
    )
