"""The Merkle manifest against a plain recomputation."""

import hashlib
import random
import zlib

import pytest
from check_oracles import compare, connect

from permeon.llm.common import remainder
from permeon.llm.merkle import FAN, GROUP, Parent, build_manifest, lowered_text, verify
from permeon.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import AWKWARD, DOCS, clashing, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + FAN])) for i in range(0, len(levels[-1]), FAN)])
    return levels


def climb(levels, at, new):
    """(siblings up to the top, digest of the top with ``new`` at that leaf)."""
    beside = ""
    for level in levels[:-1]:
        run, slot = level[at // FAN * FAN : at // FAN * FAN + FAN], at % FAN
        beside += "".join(run[:slot] + run[slot + 1 :])
        new = digest("".join([*run[:slot], new, *run[slot + 1 :]]))
        at //= FAN
    return beside, new


def plain(rows):
    """Rows (doc_id, text, lang, source, n_chars) of the manifest, sorted."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by_lang, out = {}, []
    for lang in langs:
        mine = [(r, leaf(r[0], r[3], r[2], r[4], r[1])) for r in rows if r[2] == lang]
        by_lang[lang] = sorted(mine, key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    trees = {lang: tree([h for _, h in mine]) for lang, mine in by_lang.items()}
    over = tree([trees[lang][-1][0] for lang in langs])
    for place, lang in enumerate(langs):
        for at, (r, h) in enumerate(by_lang[lang]):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            new = leaf(r[0], r[3], r[2], r[4], r[1].translate(LOWER) if tampered and r[1] is not None else r[1])
            beside, top = climb(trees[lang], at, new)
            more, top = climb(over, place, top)
            root = over[-1][0]
            out.append((r[0], h, trees[lang][-1][0], root, digest(beside + more), top, top == root))
    return sorted(out, key=repr)


def proved(docs):
    return sorted((tuple(r) for r in verify(build_manifest(docs, lowered_text(remainder("doc_id", 3) == 0))).collect()), key=repr)


def test_states_resume_at_every_slot():
    run = "".join(digest(str(i)) for i in range(5)).encode()
    parent, new = Parent(run), digest("new").encode()
    assert parent.digest.decode() == hashlib.sha256(run).hexdigest()
    for slot in range(5):
        assert parent.fold(slot, new).decode() == hashlib.sha256(run[: 64 * slot] + new + run[64 * slot + 64 :]).hexdigest()


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"en": GROUP + 1, "de": 1, None: 70}, {"xx": 5 * GROUP, "東": 8 * GROUP + 3, "": 64}])
def test_same_as_plain(spark, sizes):
    rng = random.Random(4)
    ids = rng.sample(range(-5000, 50_000), sum(sizes.values()))
    rows = []
    for lang, n in sizes.items():
        rows += [(ids.pop(), prose(rng.randint(0, 50), 6), lang, rng.choice([None, "s", "é"]), rng.choice([None, 0, 7])) for _ in range(n)]
    assert proved(spark.createDataFrame(rows, DOCS).repartition(5)) == plain(rows)


def test_many_languages(spark):
    rows = [(i, f"Text {i}", f"l{i % 90}", "s", 1) for i in range(200)]
    assert proved(spark.createDataFrame(rows, DOCS)) == plain(rows)


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = proved(clashing(docs))
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert len(got) == len(AWKWARD)
    assert proved(spark.createDataFrame([], DOCS)) == [] and build_manifest(spark.createDataFrame([], DOCS)).root is None


def test_nothing_replaced_verifies(spark):
    docs = documents(spark, [(i, f"Text {i}") for i in range(40)])
    assert verify(build_manifest(docs)).where("NOT verified").count() == 0


def test_query_same_as_sql(spark, data):
    assert compare(QUERIES["op12_merkle"](spark, data), connect(data), ORACLES["op12_merkle"]) is None
