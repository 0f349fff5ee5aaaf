"""The pipeline's near-duplicate stage against brute force over exact shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_dedup
from permeon.llm.near_copies import links, near_copies, sketches
from tests.llm.helpers import AWKWARD, clashing, documents, prose
from tests.llm.test_copies import LOWER, plain_components


def plain_set(text):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def is_near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def changed(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"changed{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = list(AWKWARD)
    for b, words in enumerate((100, 200, 300, 60)):
        base = prose(700 + b, words)
        out += [(1000 * (b + 1), base)]
        out += [(1000 * (b + 1) + i, changed(base, 1 + i % 7, 31 * b + i)) for i in range(1, 40)]
    chain = prose(750, 120).split()
    for i in range(12):
        chain = chain[5:] + [f"new{i}x{j}" for j in range(5)]
        out.append((9000 + i, " ".join(chain)))
    return out + [(9100 + i, prose(800 + i, 80)) for i in range(10)]


@pytest.mark.parametrize("group", [2048, 5])
def test_components_of_similarity(spark, rows, group):
    sets = [plain_set(t) for _, t in rows]
    root = plain_components(sets, is_near)
    docs = documents(spark, rows).withColumnRenamed("source", "other").coalesce(2)
    got = {}
    for r in near_copies(docs, group).collect():
        got.setdefault(r["component"], []).append(str(r["doc_id"]))
    want = {}
    for (k, _), r in zip(rows, root, strict=True):
        want.setdefault(r, []).append(str(k))
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values())


def test_links_of_texts_from_one_template_stay_few(spark):
    """Many texts of one template, none of them copies, and some that are: what tasks send grows with the texts, not their pairs."""
    base = prose(990, 100)
    sent = []
    for n in (150, 300):
        rows = [(i, changed(base, 3, 7 * i + 1)) for i in range(n)] + [(n + i, changed(base, 1, 70_000 + i)) for i in range(20)]
        docs = documents(spark, rows)
        nodes = sketches(docs).select("fp", "signature", "keys").dropDuplicates(["fp"]).persist()
        sent.append(links(docs, nodes).count())
        sets = [plain_set(t) for _, t in rows]
        assert near_copies(docs).select("component").distinct().count() == len(set(plain_components(sets, is_near)))
    assert sent[1] < 2.6 * max(sent[0], 50) and sent[1] < 20 * 320


def test_words_that_collide_in_polynomial_hashes_differ(spark):
    turn = {"a": "b", "b": "a"}
    text = "a"
    while len(text) < 1024:
        text += "".join(turn[c] for c in text)
    rows = documents(spark, [(1, text), (2, "".join(turn[c] for c in text)), (3, text.upper())])
    found = {r["doc_id"]: r["component"] for r in near_copies(rows).collect()}
    assert found[1] == found[3] != found[2]


def test_clashing_columns_keep_their_values(spark):
    docs = clashing(documents(spark, [(1, "one text"), (2, "another text"), (3, "one text")]))
    kept = {tuple(r) for r in near_dedup(spark, docs, "").collect()}
    assert kept == {tuple(r) for r in docs.where("doc_id < 3").collect()}


def test_stage_keeps_no_near_copies(spark, rows):
    docs = clashing(documents(spark, rows))
    kept = near_dedup(spark, docs, "")
    sets = [plain_set(t) for _, t in rows]
    root = plain_components(sets, is_near)
    got = kept.collect()
    assert kept.columns == docs.columns and len(got) == len(set(root))
    left = [plain_set(r["text"]) for r in got]
    assert not any(is_near(a, b) for i, a in enumerate(left) for b in left[:i])
    assert near_dedup(spark, documents(spark, []), "").count() == 0


def test_simhash_components_are_candidates(spark):
    from permeon.llm.near_copies import simhash_groups

    base = prose(880, 900)
    rows = [(1, base), (2, changed(base, 1, 5)), (3, base + " end"), (4, prose(881, 900)), (None, prose(882, 300)), (6, "")]
    docs = documents(spark, rows)
    found = sketches(docs).persist()
    groups = simhash_groups(docs, found)
    of = {r["fp"]: r["key"] for r in groups.collect()}
    ids = {r["doc_id"]: r["fp"] for r in found.collect()}
    assert groups.count() == 6 and of[ids[1]] == of[ids[3]] != of[ids[4]]
    # Without a band, the texts of one SimHash component are still compared.
    nodes = found.select("fp", "signature", F.expr("cast(array() as array<bigint>)").alias("keys"))
    assert links(docs, nodes).count() == 0
    joined = {frozenset(r) for r in links(docs, nodes, groups=groups).collect()}
    assert frozenset((ids[1], ids[3])) in joined and not any(ids[4] in pair for pair in joined)
