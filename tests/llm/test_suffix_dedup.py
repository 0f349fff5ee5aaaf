"""Dealing and sorting of pieces in suffix-array dedup."""

import random

import numpy as np
import pyarrow as pa
import pytest

from permeon.llm import suffix_dedup
from permeon.llm.common import mix
from tests.llm.helpers import prose


def _laid(pieces):
    data = np.frombuffer(b"".join(p for _, p, _ in pieces), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(p) for _, p, _ in pieces])))
    return data, bounds, np.array([k for k, _, _ in pieces], np.uint32), np.array([d for _, _, d in pieces])


def plain_least(pieces, length):
    """For each window of each piece the least document of its key that has it."""
    least = {}
    for k, p, d in pieces:
        for i in range(len(p) - length + 1):
            w = (k, p[i : i + length])
            least[w] = min(d, least.get(w, d))
    return [least[k, p[i : i + length]] for k, p, _ in pieces for i in range(len(p) - length + 1)]


def test_anchors_spread_over_buckets():
    runs = suffix_dedup.anchor_runs(pa.array([prose(i, 400) for i in range(40)]), 50)
    counts = np.bincount(suffix_dedup._bucket(np.unique(runs.anchor), 16), minlength=16)
    assert counts.max() < 2 * counts.mean()


def test_runs_cover_each_window_once():
    texts = ["", "a" * 49, prose(1, 60), None, "b" * 50, "xy" * 300, "é" * 40, ""]
    runs = suffix_dedup.anchor_runs(pa.array(texts), 50)
    sizes = [len((t or "").encode()) for t in texts]
    first = np.concatenate(([0], np.cumsum(sizes)))
    want = [(i, first[i] + j) for i, n in enumerate(sizes) for j in range(n - 49)]
    assert [(d, s + j) for d, s, n in zip(runs.doc, runs.start, runs.size, strict=True) for j in range(n)] == want


@pytest.mark.parametrize("length", [24, 39, 40, 50])
def test_least_documents_by_brute_force(length):
    rng = random.Random(length)
    base = [prose(i, 60).encode() for i in range(4)] + [b"ab" * 200, b"z" * 300]
    pieces = []
    for key in range(30):
        text = rng.choice(base)
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            start = rng.randrange(len(text) - length - 60)
            piece = bytearray(text[start : start + length + rng.randrange(60)])
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = 35
            pieces.append((key, bytes(piece), rng.randrange(50)))
    assert suffix_dedup.least_documents(*_laid(pieces), length).tolist() == plain_least(pieces, length)


def test_only_what_shares_a_long_gram_is_sorted(monkeypatch):
    sorted_symbols = []
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda text, bounds, f=suffix_dedup.suffix_arrays: sorted_symbols.append(len(text)) or f(text, bounds))
    middle, shared = b"sixteen of bytes", prose(7, 30).encode()[:80]
    pieces = [(1, prose(i, 20).encode()[:34] + middle + prose(100 + i, 20).encode()[:34], i) for i in range(50)]
    pieces += [(2, shared[:70], 4), (2, shared[5:75], 3), (2, shared, 9)]
    assert suffix_dedup.least_documents(*_laid(pieces), 50).tolist() == plain_least(pieces, 50)
    assert 0 < sum(sorted_symbols) < 500


def test_slots_of_hot_anchors():
    texts = pa.array([prose(i, 10) + " a passage that is hot " + prose(50 + i, 10) for i in range(30)])
    data, _ = suffix_dedup._bytes_of(texts)
    runs = suffix_dedup.anchor_runs(texts, 50)
    which = np.arange(0, len(runs.size), 2)
    run, start, size, key = suffix_dedup._slots(runs, which, data, 50)
    got = [(r, s + j) for r, s, n in zip(run, start, size, strict=True) for j in range(n)]
    assert got == [(r, runs.start[r] + j) for r in which for j in range(runs.size[r])]
    by_text = {}
    for r, s, n, k in zip(run, start, size, key, strict=True):
        for j in range(s, s + n):
            by_text.setdefault(data[j : j + 50].tobytes(), set()).add(int(k))
            hashes = [int(mix(suffix_dedup._grams(data[j + d : j + d + 16], 16))[0]) for d in range(35)]
            assert int(runs.anchor[r]) in hashes
    assert all(len(k) == 1 for k in by_text.values())
