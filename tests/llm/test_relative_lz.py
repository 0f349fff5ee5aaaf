"""Relative Lempel-Ziv removal of repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon.llm.queries import QUERIES
from permeon.llm.relative_lz import duplicate_windows, remove_duplicate_windows
from tests.llm.helpers import AWKWARD, DOCS, clashing, documents, prose


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window=20):
    """(n_words, n_removed, kept, spans) of rows (id, text) with distinct ids, null last."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        spans, at = [], 0
        while at < len(words):
            n = 0
            while at + n < len(words) and gone[at + n]:
                n += 1
            if n:
                spans.append((at, n))
            at += max(n, 1)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g), spans)
    return out


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"], [(s["first"], s["words"]) for s in r["spans"]]) for r in df.collect()}


def corpus():
    rng = random.Random(5)
    passage, vocabulary = prose(99, 60), prose(98, 12).split()
    rows = [(i, prose(i, rng.randint(10, 200))) for i in range(30)]
    # One passage in many surroundings, parts of it, copies, and few words in many orders.
    rows += [(100 + i, f"{prose(200 + i, 25)} {passage}\n\n{prose(300 + i, 25)}") for i in range(90)]
    rows += [(200 + i, " ".join(passage.split()[i : i + 21 + i])) for i in range(20)]
    rows += [(300 + i, rows[i][1].replace(" ", "  ")) for i in range(5)]
    rows += [(400 + i, " ".join(rng.choice(vocabulary[:2]) for _ in range(300))) for i in range(4)]
    rows += [(410, "a " * 500), (411, "a b " * 100), (412, " ".join(["x"] * 19)), (413, " ".join(["x"] * 20)), (414, " ".join(["x"] * 21))]
    rows += [(420, prose(1, 8000)), (-7, passage.upper()), (-8, passage), (None, f"{passage} end"), (2**62, "東京 " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_pieces": 1, "group_bytes": 3000, "bucket_bytes": 5000}, {"gram": 1}, {"window": 7, "gram": 3}])
def test_same_as_brute_force(spark, options):
    rows = corpus()
    want = plain(rows, options.get("window", 20))
    assert sum(w[1] for w in want.values()) > 5000
    assert found(remove_duplicate_windows(documents(spark, rows), **options)) == want


def test_parse_marks_windows_that_straddle_factors():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pieces = [rng.integers(0, 3, rng.integers(5, 40)) for _ in range(30)]
        bounds = np.cumsum([0, *map(len, pieces)])
        bits = duplicate_windows(np.concatenate(pieces), bounds, 5)
        seen = set()
        for piece, got in zip(pieces, bits.tolist(), strict=True):
            for i in range(len(piece) - 4):
                w = tuple(piece[i : i + 5])
                assert (got >> i & 1) == (w in seen)
                seen.add(w)


def test_awkward_rows(spark):
    long = prose(7, 60)
    rows = [*AWKWARD, (20, long), (20, long), (None, long), (None, long), (30, long + " more"), (None, prose(8, 30)), (None, prose(8, 30) + " x")]
    got = remove_duplicate_windows(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    # Rows equal in id and text are one document, null ids come last.
    assert by_id[20] == [(60, 0), (60, 0)] and by_id[30] == [(61, 60)] and by_id[1] == [(0, 0)]
    of_null = sorted(by_id[None])
    assert of_null.count((60, 60)) == 2
    # One of the two texts without id goes before the other.
    assert {(30, 0), (31, 30)} <= set(of_null) or {(30, 30), (31, 0)} <= set(of_null)
    assert remove_duplicate_windows(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_of_any_type(spark):
    text = prose(7, 60)
    docs = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_duplicate_windows(docs).collect()} == {"a": 0, "b": 60, None: 60}


def test_query_on_the_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept, _) in plain(rows).items()}
    got = QUERIES["op11_substring_dedup"](spark, data)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert got.agg(F.sum("n_removed")).first()[0] > 0
