"""Word arithmetic, suffix arrays and maximal segments against plain definitions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from permeon.llm import common
from permeon.llm.suffix_array import suffix_arrays
from permeon.llm.toxicity import maximal_segments

TEXT = st.text(alphabet="aB1 é\n\t東.#", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, size):
    found = []
    for block in common.text_blocks(pa.array(texts, pa.string()), size):
        words = common.split_words(block.data, block.offsets, common.NOT_BLANK)
        for i in range(block.last - block.first):
            a, b = words.first[i], words.first[i + 1]
            found.append([block.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_equal_ranges_have_equal_hashes(text):
    data = np.frombuffer((text + text).encode(), np.uint8)
    n = len(data) // 2
    a, b = np.arange(n), np.arange(n) + 1
    assert (common.range_hashes(data, a, b) == common.range_hashes(data, a + n, b + n)).all()
    distinct = {bytes(data[i : i + 1]) for i in range(n)}
    assert len(set(common.range_hashes(data, a, b).tolist())) == len(distinct)


def test_slices_of_arrow_columns():
    column = pa.array(["drop", "a b", None, "", "c"], pa.string()).slice(1)
    (block,) = common.text_blocks(column)
    assert block.data.tobytes() == b"a bc" and block.offsets.tolist() == [0, 3, 3, 3, 4]
    assert not list(common.text_blocks(pa.array([], pa.string())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=24), min_size=1, max_size=5), st.integers(1, 4))
def test_suffix_arrays(strings, repeat):
    strings = [s * repeat for s in strings]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    symbols = np.array([x for s in strings for x in s], np.int64)
    got = suffix_arrays(symbols, bounds)
    for a, s in zip(bounds, strings, strict=False):
        assert got[a : a + len(s)].tolist() == [a + j for j in sorted(range(len(s)), key=lambda j: s[j:])]


def plain_segments(scores, low, high):
    """Recursive definition: the best segment, then the best ones on either side."""
    best = max(((sum(scores[a:b]), -(b - a), -a, (a, b)) for a in range(low, high) for b in range(a + 1, high + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3]
    return [*plain_segments(scores, low, a), (a, b, best[0]), *plain_segments(scores, b, high)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=16))
def test_maximal_segments(values):
    # Distinct fractions, so that no two segments tie.
    scores = [v + (i + 1) ** 2 * 1e-4 for i, v in enumerate(values)]
    got = maximal_segments(np.array(scores))
    want = plain_segments(scores, 0, len(scores))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
