"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts become shingles of five words. A template with t shingles is looked for at
the scale s, the least power of two of at least 1.25 t: windows hold 2 s shingles
and start every s, so that some window holds any copy of the template, a quarter
of its length in insertions included. Such a window's Jaccard similarity with the
template is at least JACCARD when it contains a share CONTAINMENT of it; with
bands of one row, BANDS of them find it with a probability of at least CERTAINTY.
Every candidate is then verified by its words, so bands only ever miss, with at
most that probability, and never add.

Templates may be many: only a bitmap of CELLS bits is broadcast. Results depend
on the text alone, so equal texts are one text until the last join.

Defined results: a null text, or one of fewer than five words, matches nothing,
and neither does a template of fewer than five words. Repeated templates of one id
count once. Repeated rows each get their result. Columns other than those named are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.llm.common import LOWER, WORD_BYTES, in_arrow, mix, ragged, range_hashes, split_words, stored, text_blocks, window_hashes

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
ROOM = 1.25
#: 0.8 t shared, of 2 s + 0.2 t in the union, where t is over s / (2 ROOM).
JACCARD = CONTAINMENT / (2 * ROOM) / (2 + (1 - CONTAINMENT) / (2 * ROOM))
CERTAINTY = 0.999
BANDS = math.ceil(math.log(1 - CERTAINTY) / math.log(1 - JACCARD))
CELL_BITS = 22
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Short notices and standard headers of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def license_templates(spark: SparkSession) -> DataFrame:
    """The built-in templates as (license_id, text)."""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")


def scale_of(n_shingles: int) -> int:
    """Shingles in half a window for a template of so many."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, ROOM * n_shingles))))


def _salt(band: int, scale: int = 0) -> np.uint64:
    return mix(np.array([band * 4096 + scale.bit_length() + 1], np.uint64))[0]


def _band_keys(least: np.ndarray, band: int, scale: int) -> np.ndarray:
    return mix(least ^ _salt(band, scale))


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    words = split_words(low, offsets, WORD_BYTES)
    h = window_hashes(range_hashes(low, words.starts, words.ends), SHINGLE_WORDS)
    return low, words, h, np.maximum(np.diff(words.first) - SHINGLE_WORDS + 1, 0)


def _joined(low, words, a: int, b: int) -> str:
    return b" ".join(low[s:e].tobytes() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)).decode("utf-8", "replace")


def _template_bands(batches):
    for batch in batches:
        row, text, total, scale, keys = [], [], [], [], []
        for block in text_blocks(batch.column(1)):
            low, words, h, sizes = _shingle_hashes(block.data, block.offsets)
            for i, n in enumerate(sizes.tolist()):
                if n:
                    own, s = h[words.first[i] : words.first[i] + n], scale_of(n)
                    row.append(block.first + i)
                    text.append(_joined(low, words, int(words.first[i]), int(words.first[i + 1])))
                    scale.append(s)
                    keys.append([int(_band_keys(np.array([mix(own ^ _salt(b)).min()]), b, s).view(np.int64)[0]) for b in range(BANDS)])
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(text, pa.string()), pa.array(scale, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["license_id", "template", "scale", "bands"])


def _shingles(words: Column) -> Column:
    """Distinct space-joined shingles of an array of words."""
    starts = F.sequence(F.lit(1), F.size(words) - SHINGLE_WORDS + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE_WORDS)), " ")))


def template_table(templates: DataFrame) -> DataFrame:
    """license_id, shingles, scale and band keys of every template that has a shingle."""
    rows = templates.select("license_id", "text").where("license_id IS NOT NULL").distinct()
    found = rows.transform(in_arrow, _template_bands, "license_id string, template string, scale int, bands array<bigint>")
    return found.select("license_id", _shingles(F.split("template", " ")).alias("shingles"), "scale", "bands")


def _window_minima(h: np.ndarray, sizes: np.ndarray, first: np.ndarray, scales: list[int]):
    """For every band and scale: (band, scale, minima of the windows, document and first shingle of each)."""
    top = max(scales)
    padded = (sizes + top - 1) // top * top
    begin = np.cumsum(padded) - padded
    laid = np.full(int(padded.sum()), _NONE)
    to = ragged(begin, sizes)
    laid[to] = h[ragged(first[:-1], sizes)]
    empty = np.ones(len(laid), bool)
    empty[to] = False
    doc = np.repeat(np.arange(len(sizes)), padded)
    for band in range(BANDS):
        least = mix(laid ^ _salt(band))
        least[empty] = _NONE
        step = 1
        while True:
            if step in scales:
                of = doc[::step]
                window = least.copy()
                same = of[1:] == of[:-1]
                window[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                yield band, step, window, of, np.arange(len(of)) * step - begin[of]
            if step >= top:
                break
            least = np.minimum(least[::2], least[1::2])
            step *= 2


def window_candidates(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per document (scale null), and one per window that shares a band with some template, with its words."""
    cell = F.expr(f"shiftrightunsigned(band, {64 - CELL_BITS})")
    cells = templates.select(F.explode("bands").alias("band")).select(cell.alias("c")).distinct().toArrow().column("c").to_numpy()
    scales = sorted(r[0] for r in templates.select("scale").distinct().collect())
    bits = np.zeros(1 << CELL_BITS, bool)
    bits[cells] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    rows = docs.select(F.col("text").alias("_text"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def found(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                low, words, h, sizes = _shingle_hashes(block.data, block.offsets)
                hits: dict[tuple[int, int, int], list[int]] = {}
                if scales and sizes.any():
                    for band, scale, least, doc, start in _window_minima(h, sizes, words.first, scales):
                        keys = _band_keys(least, band, scale)
                        hit = np.flatnonzero(bits[(keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)] & (least != _NONE))
                        for d, s, k in zip(doc[hit].tolist(), start[hit].tolist(), keys[hit].view(np.int64).tolist(), strict=True):
                            hits.setdefault((d, scale, s), []).append(k)
                n = len(sizes)
                row, scale, first = list(range(n)), [None] * n, [None] * n
                text, bands = [None] * n, [None] * n
                for (d, s, at), keys in hits.items():
                    a = int(words.first[d]) + at
                    row.append(d)
                    scale.append(s)
                    first.append(at)
                    text.append(_joined(low, words, a, min(a + 2 * s + SHINGLE_WORDS - 1, int(words.first[d + 1]))))
                    bands.append(keys)
                of_row = pa.array(np.array(row, np.int64) + block.first)
                columns = [batch.column(1).take(of_row), batch.column(2).take(of_row), pa.array(scale, pa.int32()), pa.array(first, pa.int64()), pa.array(text, pa.string()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "scale", "first_word", "window", "bands"])

    return rows.transform(in_arrow, found, f"doc_id {kind}, key binary, scale int, first_word bigint, window string, bands array<bigint>")


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, key (md5 of the text) and matches, sorted structs of license_id, containment and first_word, of every row.

    ``first_word`` is where the best window starts, the first of equals.
    """
    known = stored(template_table(templates), "license-templates")
    found = stored(window_candidates(docs, known), "license-windows")
    windows = found.where("scale IS NOT NULL").dropDuplicates(["key", "scale", "first_word"])
    by_band = windows.select("key", "first_word", "window", "scale", F.explode("bands").alias("band"))
    bands = known.select("license_id", "shingles", "scale", F.explode("bands").alias("band"))
    pairs = by_band.join(bands, ["scale", "band"]).groupBy("key", "first_word", "scale", "license_id").agg(F.first("window").alias("window"), F.first("shingles").alias("shingles"))
    shared = F.size(F.array_intersect("shingles", _shingles(F.split("window", " "))))
    held = pairs.select("key", "license_id", "first_word", (shared / F.size("shingles")).alias("containment")).where(F.col("containment") >= containment)
    best = held.groupBy("key", "license_id").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("b"))
    match = F.struct("license_id", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("first_word"))
    matches = best.groupBy("key").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    rows = found.where("scale IS NULL").select("doc_id", "key").join(matches, "key", "left")
    none = F.array().cast("array<struct<license_id: string, containment: double, first_word: bigint>>")
    return rows.select("doc_id", "key", F.coalesce("matches", none).alias("matches"))
