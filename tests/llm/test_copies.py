"""SimHash, suffix-array and benchmark operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from check_oracles import compare, connect
from pyspark.sql import functions as F

from permeon.llm.components import components
from permeon.llm.decontamination import drop_contaminated, find_contamination, is_contaminated
from permeon.llm.queries import ORACLES, QUERIES
from permeon.llm.simhash import links, near_duplicates, one_of_each
from permeon.llm.suffix_dedup import removal_report, remove_repeats
from tests.llm.helpers import AWKWARD, clashing, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("group", [2048, 2])
def test_links_connect_what_is_near(spark, group):
    rng = random.Random(group)
    values = {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(120):
            v = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), group)
    root = dict(components(found).collect())
    got = [root.get(v, v) for v in signed]
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 150)]
    got = dict(components(spark.createDataFrame([*path, *star, (7, 7), (3, 2)], "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 150)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.fixture(scope="module")
def copies():
    """Exact and near copies, shared passages, periodic text and the awkward rows."""
    base = [prose(i, 150) for i in range(8)]
    passage = prose(99, 30)
    rows = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(30, base[0]), (31, base[0]), (32, base[1].replace("th", "TH", 1)), (33, base[2] + " end"), (34, "x " + base[3])]
    rows += [(40 + i, prose(200 + i, 20) + passage + prose(300 + i, 20)) for i in range(12)]
    rows += [(60, "ab" * 200), (61, "ba" * 150), (62, "Pf " * 400), (63, base[4][:49]), (64, base[4][:50]), (65, base[4][13:63])]
    return rows + AWKWARD


def test_near_duplicates(spark, copies):
    got = near_duplicates(clashing(documents(spark, copies)))
    rows = sorted(((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in copies]
    root = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(copies, root, strict=True):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    want = sorted(((k is None, k, f"{p:016x}", least[r]) for (k, _), p, r in zip(copies, prints, root, strict=True)), key=str)
    assert rows == want
    kept = one_of_each(clashing(documents(spark, copies)))
    assert kept.count() == len(set(root)) and kept.columns == clashing(documents(spark, [])).columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {v for v in least.values() if v is not None} <= ids


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert one_of_each(documents(spark, [])).count() == 0


def plain_removal(rows, length=50):
    """Per row the bytes, and which go."""
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        earlier = {o[i : i + length] for j, u in rows if j is not None and (k is None or j < k) for o in [(u or "").encode()] for i in range(len(o) - length + 1)}
        for i in range(len(b) - length + 1):
            if b[i : i + length] in earlier:
                gone[i : i + length] = b"\1" * length
        out.append((k, b, gone))
    return out


@pytest.mark.parametrize(("hot", "group"), [(64, 4 << 20), (2, 4 << 20), (1, 300)])
def test_removal(spark, copies, hot, group):
    got = removal_report(clashing(documents(spark, copies)), group_bytes=group, bucket_bytes=group, hot_pieces=hot)
    want = []
    for k, b, gone in plain_removal(copies):
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_remove_repeats_keeps_rows_and_columns(spark, copies):
    docs = clashing(documents(spark, copies))
    got = remove_repeats(docs)
    assert got.columns == docs.columns
    want = []
    for (k, t), (_, b, gone) in zip(copies, plain_removal(copies), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((k, None if t is None else kept, None if t is None else len(kept), "other"))
    assert sorted(map(tuple, got.select("doc_id", "text", "n_chars", "key").collect()), key=str) == sorted(want, key=str)
    assert remove_repeats(documents(spark, [])).count() == 0


def plain_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    own, hit, found = words(text), set(), set()
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    if k is not None:
                        found.add(str(k))
    return len(own), len(hit), tuple(sorted(found))


def test_contamination(spark):
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (10, prose(1, 40)), (3, "two words"), (4, "alone"), (5, None), (6, ""), (5, "-- --"), (None, prose(3, 20)), (2, prose(2, 13))]
    rows = [
        (1, prose(1, 40)),
        (2, prose(50, 30) + " " + prose(1, 40).upper().replace(" ", " -- ") + " " + prose(51, 400)),
        (3, "an alone word, then two  Words; and ALONE again"),
        (4, prose(2, 12)),
        (5, prose(52, 300) + " alone " + prose(53, 300)),
        (6, " ".join(prose(1, 40).split()[5:17])),
        (7, prose(3, 20)),
        (8, "two"),
        *AWKWARD,
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit("other"))
    got = find_contamination(clashing(documents(spark, rows)), benchmark)
    want = [(k, *plain_contamination(t, items)) for k, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=str) == sorted(want, key=str)
    bad = {k for k, n, hit, _ in want if hit and 20 * hit >= n}
    assert {r[0] for r in got.where(is_contaminated()).select("doc_id").collect()} == bad == {1, 2, 3, 7}
    kept = drop_contaminated(clashing(documents(spark, rows)), benchmark)
    assert kept.count() == len(rows) - len(bad) and kept.columns == clashing(documents(spark, [])).columns
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert drop_contaminated(documents(spark, rows), nothing).count() == len(rows)
    assert find_contamination(documents(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, data):
    assert compare(QUERIES[name](spark, data), connect(data), ORACLES[name]) is None


def test_ids_of_any_type_and_null_ids(spark):
    text = prose(7, 40)
    docs = spark.createDataFrame([("b", text), ("a", text), (None, text), (None, text + " more")], "doc_id string, text string")
    report = removal_report(docs).collect()
    assert sorted(str(r["doc_id"]) for r in report) == ["None", "None", "a", "b"]
    assert sorted(r["n_removed"] for r in report) == sorted([0, len(text.encode()), len(text.encode()), len(text.encode())])
    kept = {(r["doc_id"], r["text"]) for r in remove_repeats(docs).collect()}
    assert ("a", text) in kept and ("b", "") in kept
