"""Importance resampling against a plain version and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from check_oracles import compare, connect

from permeon.llm.importance import feature_counts, resample, words_of
from permeon.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import AWKWARD, DOCS, clashing, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, least=20, percent=10):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(code(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(code(f) for x in target for f in features(x, n)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for key, text in docs:
        words, found = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(code(f)) for f in found)
        rows.append([key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r.append(i + 1)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=repr)


def texts():
    rows = [(i, prose(i % 70, 1 + i * 7 % 90)) for i in range(230)]
    return [*AWKWARD, *rows, (900, prose(3, 4000)), (901, "Ünï-CODE_x2" * 30), (902, "a_b c'd É É " * 9)]


TARGET = [prose(i, 40) for i in range(5)] + [None, "", "une deux"]


@pytest.mark.parametrize("options", [{}, {"n": 3, "buckets": 50}, {"percent": 100, "least": 0}])
def test_same_as_plain(spark, options):
    docs = texts()
    names = {"least": "least_words"}
    got = resample(clashing(documents(spark, docs)), spark.createDataFrame([(t,) for t in TARGET], "text string"), **{names.get(k, k): v for k, v in options.items()})
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, TARGET, **options)


def test_words_and_chained_hashes():
    assert words_of("Été—L'ÉTÉ 2x_y\x00Z".encode()) == ["Été—l".encode(), "ÉtÉ".encode(), b"2x", b"y", b"z"]
    got = feature_counts([b"a", b"b", b"a", b"b"], 2, 1 << 32)
    assert got == Counter({zlib.crc32(b"a"): 2, zlib.crc32(b"b"): 2, zlib.crc32(b"a b"): 2, zlib.crc32(b"b a"): 1})


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample(none, none).count() == 0
    alone = resample(documents(spark, [(1, "a b c")]), none, least_words=1, percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in alone] == [(3, 1)]


def test_query_same_as_sql(spark, data):
    assert compare(QUERIES["op13_importance_resampling"](spark, data), connect(data), ORACLES["op13_importance_resampling"]) is None
