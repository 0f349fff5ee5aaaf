"""Packing, sharding and license scan, and the pipeline, against plain versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from permeon.llm import license_scan
from permeon.llm.packing import END_ID, Encoder, pack, piece_lengths
from permeon.llm.queries import QUERIES
from permeon.llm.sharding import assign_shards, schedule
from tests.llm.helpers import AWKWARD, clashing, documents, prose

SPACES = [
    (50, "  two  spaces\n\n and   runs \t of\xa0 blanks \u3000 x"), (51, "don't we'll I'M 's ' s été ñandú Ärger é é"), (52, "a <|endoftext|> b<|endoftext|>c"),
    (53, " lead"), (54, "trail "), (55, "1 2  3 ½ ٣ 漢字 かな 🙂 🙂"), (56, "é " * 300), (57, prose(5, 3000)), (58, "\u2003 x\u2003y é\u2003 z"),
]


def test_packing(spark):
    rows = AWKWARD + SPACES
    got = pack(clashing(documents(spark, rows)), 256).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for key in {k for k, _ in rows}:
        want = []
        for text in (t for k, t in rows if k == key):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
            at = 0
            for n in piece_lengths(len(ids), 256):
                part = ids[at : at + n]
                want.append((at, n, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), part))
                at += n
            assert at == len(ids)
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]) for r in by_doc[key]) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] and r["length"] <= 256 for r in got)
    assert pack(documents(spark, [])).count() == 0


def test_texts_that_collide_in_polynomial_hashes_keep_their_ids(spark):
    turn = {"a": "b", "b": "a"}
    text = "a"
    while len(text) < 1024:
        text += "".join(turn[c] for c in text)
    other = "".join(turn[c] for c in text)
    got = {r["doc_id"]: r["ids"] for r in pack(documents(spark, [(1, text), (2, other)]).coalesce(1), 2048).where("start = 0").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for key, t in ((1, text), (2, other)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, END_ID]
        assert got[key] == ids[: len(got[key])] and got[key]
    assert got[1] != got[2]


def test_encoder_gives_the_tokenizers_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, theirs = Encoder(path), Tokenizer.from_file(path)
    assert mine.fast is not None
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x2003, 0x2028, 0x3000, 0x6771, 0x1F642, 0x1D518, 0xFEFF]] + list("  \n\n\t''sdmtlrve  ")
    for _ in range(400):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 80)))
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    for text in ["x" * 20_000, " " * 5000, "ab1" * 5000, "漢字" * 3000]:
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine = Encoder(path)
    assert mine.fast is None
    assert mine.encode("Some Words").tolist() == Tokenizer.from_file(path).encode("Some Words", add_special_tokens=False).ids


def test_piece_lengths():
    assert piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert piece_lengths(2048) == [2048] and piece_lengths(1) == [1]
    with pytest.raises(ValueError):
        pack(None, 100)


def test_schedule_is_longest_first():
    items = [(7, "a"), (6, "b"), (5, "c"), (5, "d"), (4, "e"), (1, "f")]
    place = schedule(items, 2)
    loads, want = [0, 0], {}
    for size, key in items:
        s = loads.index(min(loads))
        want[key] = s
        loads[s] += size
    assert place == want


def test_shards(spark):
    rows = AWKWARD + [(100 + i, prose(i % 60, 5 + i % 60)) for i in range(400)] + [(900 + i, "the same") for i in range(30)]
    got = assign_shards(clashing(documents(spark, rows)), 4).collect()
    assert len(got) == len(rows)
    size = sorted((r["size"], r["text_crc32"]) for r in got)
    assert size == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    home, loads, slots = {}, {}, {}
    for r in got:
        home.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in home.values())
    assert max(loads.values()) - min(loads.values()) <= 0.03 * sum(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(documents(spark, []), 4).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_licenses(spark):
    rng = random.Random(3)
    texts = license_scan.TEMPLATES
    rows, planted = list(AWKWARD), {}
    for i, (name, template) in enumerate(sorted(texts.items()) * 3):
        body = prose(i, 200).split()
        notice = template.split()
        if i >= 2 * len(texts) and len(notice) > 25:
            notice[len(notice) // 2] = "something"
        at = rng.randrange(len(body))
        rows.append((100 + i, " ".join([*body[:at], *notice, *body[at:]]) if i % 2 else template.upper()))
        planted[100 + i] = name
    rows += [(800, texts["MIT"]), (800, texts["MIT"]), (801, "Released under the MIT"), (802, prose(9, 300))]
    templates = license_scan.license_templates(spark).union(spark.createDataFrame([("short", "two words"), ("none", None), ("MIT", texts["MIT"])], "license_id string, text string"))
    got = license_scan.scan_licenses(clashing(documents(spark, rows)), templates).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append({m["license_id"]: m for m in r["matches"]})
    assert all(planted[k] in found[k][0] for k in planted)
    for k, text in rows:
        own = words_of(text)
        for matches in found[k]:
            for name, m in matches.items():
                want = shingles_of(words_of(texts[name]))
                near = shingles_of(own[m["first_word"] : m["first_word"] + 2 * license_scan.scale_of(len(want)) + 4])
                assert m["containment"] == pytest.approx(len(want & near) / len(want)) and m["containment"] >= 0.8
    for k, text in rows:
        for name, template in texts.items():
            if f" {' '.join(words_of(template))} " in f" {' '.join(words_of(text))} ":
                assert name in found[k][0]
    assert found[801] == [{}] and found[802] == [{}] and len(found[800]) == 2
    nothing = spark.createDataFrame([], "license_id string, text string")
    assert {len(r["matches"]) for r in license_scan.scan_licenses(documents(spark, rows), nothing).collect()} == {0}
    assert license_scan.scan_licenses(documents(spark, []), templates).count() == 0


def test_band_settings_find_what_they_promise():
    assert 1 - (1 - license_scan.JACCARD) ** license_scan.BANDS >= license_scan.CERTAINTY
    for t in range(1, 400):
        s = license_scan.scale_of(t)
        assert s >= 1.25 * t and (s == 1 or s / 2 < 1.25 * t or s == 2)
        assert 0.8 * t / (2 * s + 0.2 * t) >= license_scan.JACCARD - 1e-9 or t == 1


def test_pipeline(spark, data, tmp_path):
    """Stage by stage on its own input: what it drops and keeps."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    extra = documents(spark, [*[(k and k + 10_000_000, t) for k, t in AWKWARD]])
    docs = spark.read.parquet(f"{data}/documents.parquet").union(extra)
    before, columns, sizes = None, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
            lost = before.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).collect()
            if name == "language_id":
                assert lost and all(not any(c.isalpha() for c in r["text"] or "") for r in lost)
            if name == "suffix_dedup":
                assert sizes[name] == sizes["near_dedup"]
    assert sizes["near_dedup"] < sizes["language_id"] and sizes["decontamination"] < sizes["suffix_dedup"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.select("text").collect())
    assert docs.agg(F.sum("length")).first()[0] == want


def test_registered(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert QUERIES["op8_sharding"](spark, data).count() == n
    assert QUERIES["op4_license_scan"](spark, data).where("n_licenses > 0").count() > 0
    assert QUERIES["op10_simhash"](spark, data).count() == QUERIES["op7_suffix_dedup"](spark, data).count() == n
    assert QUERIES["op3_packing"](spark, data).select("doc_id").distinct().count() == n
