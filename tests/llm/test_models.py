"""Language, toxicity, URL and quality operators: edge cases, plain definitions, held-out accuracy."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permeon.llm import language_id, quality_rules, toxicity, url_filter
from permeon.llm.queries import QUERIES, URL_RULES
from tests.llm.helpers import AWKWARD, clashing, documents, prose

LANGUAGES = {"en": ["the", "th", "ing", "and", "er", "wh"], "de": ["sch", "ung", "ein", "ß", "ü", "ver"], "fr": ["eau", "é", "tion", "ç", "que", "ou"]}


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


def language_rows():
    names = sorted(LANGUAGES)
    return [(100 + i, prose(i, 30 + i % 50, LANGUAGES[names[i % 3]]), names[i % 3]) for i in range(240)]


def test_language(spark):
    rows = language_rows() + [(*r, "en") for r in AWKWARD]
    docs = clashing(documents(spark, rows))
    learnable = docs.where(F.col("doc_id") % 4 != 2)
    model = language_id.fit_language_model(learnable, rows_per_language=40)
    got = language_id.identify_language(docs.select("doc_id", "text", "lang"), model, ["doc_id", "lang", "text"]).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 100 and r["doc_id"] % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["score"] == 0)


def test_languages_of_many_copies_are_learnt(spark):
    """A language whose rows are copies of a few texts is drawn by its distinct texts."""
    rows = language_rows()
    few = [(5000 + i, prose(9000 + i % 6, 60, ["zzo", "xu", "kya", "qi"]), "xx") for i in range(1200)]
    model = language_id.fit_language_model(documents(spark, rows + few), rows_per_language=40)
    held = documents(spark, [(1, prose(1, 60, ["zzo", "xu", "kya", "qi"])), (2, rows[0][1])])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(held, model, ["doc_id"]).collect()}
    assert got == {1: "xx", 2: rows[0][2]}


def test_language_without_labels_or_rows(spark):
    docs = documents(spark, AWKWARD)
    assert language_id.fit_language_model(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language_id.identify_language(docs, None, ["doc_id"]).collect()} == {"und"}
    one = language_id.fit_language_model(docs)
    assert {r["lang_pred"] for r in language_id.identify_language(docs, one, ["doc_id"]).collect()} == {"und", "en"}
    assert language_id.identify_language(documents(spark, []), one, ["doc_id"]).count() == 0


def test_characters_and_temperature():
    data = np.frombuffer("AÀé東𝔘".encode(), np.uint8)
    codes, offsets = language_id.characters(data, np.array([0, 1, len(data)]))
    same, _ = language_id.characters(np.frombuffer("aàÉ東𝔘".encode(), np.uint8), np.array([0, 1, len(data)]))
    assert offsets.tolist() == [0, 1, 5] and codes.tolist() == same.tolist() and len(set(codes.tolist())) == 5
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(4000, 3))
    p = np.exp(scores / 0.5) / np.exp(scores / 0.5).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language_id.best_temperature(scores, labels) - 0.5) < 0.08
    assert language_id.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_ftrl_penalty_makes_weights_sparse():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        cells = np.array(sorted({i % 2, *(rng.randrange(2, 60) for _ in range(4))}))
        rows.append((i % 2, cells, np.full(len(cells), 1 / math.sqrt(len(cells)))))
    w, b = language_id.ftrl(rows, 2, 64)
    assert w[0, 0] > w[1, 0] and w[1, 1] > w[0, 1]
    assert (w == 0).sum() > 8 and np.abs(w[:, 2:]).max() < np.abs(w[:, :2]).max()


def toxic_rows():
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        words = prose(1000 + i, 60 + i % 90).split()
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(words) - 20)
            for j in range(0, 15, 3):
                words[at + j] = rng.choice(["idiot", "scum,", "Moron"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1), (0, 1, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("other"))
    table = clashing(documents(spark, docs + AWKWARD[:1] + AWKWARD[6:]))
    learnable = table.where("doc_id % 3 <> 1")
    model = toxicity.fit_toxicity(toxicity.labelled_texts(learnable, marks))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table.where("doc_id IS NOT NULL"), model, ["doc_id", "text"]).collect()}
    held = [(got[i]["score"] >= 0.7, bad) for i, _, bad in labels if i % 3 == 1 and i > 8]
    assert sum(p == bool(b) for p, b in held) >= 0.97 * len(held)
    for i, text in docs:
        if i % 6 == 0 and i > 8 and got[i]["score"] > 0.7:
            words = text.encode()
            assert any(re.search(rb"idiot|scum|Moron", words[p["first"] : p["end"]]) for p in got[i]["passages"])
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_toxicity_of_the_tables(spark, data):
    # The smallest tables have too few toxic labels to learn from.
    data = os.path.join(os.path.dirname(data), "sf0.1")
    if not os.path.isdir(data):
        pytest.skip(f"no test tables at {data}")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_toxicity"](spark, data).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert toxic and clean and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_the_curve_sees_all_segments_of_a_text(spark, monkeypatch):
    """Evidence when the curve is fitted is that of scoring, however many segments a text has."""
    seen = []
    monkeypatch.setattr(toxicity, "logistic_curve", lambda x, y: seen.append(x) or (0.0, 1.0, 1.0))
    bad, good = "vileword", "the quiet river went on past some old houses and then the hills"
    rows = [(i, f"{prose(i, 20)} {bad} {good}" if i % 2 else f"{prose(i, 20)} {good}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{bad}{k % 7} {good}" for k in range(400)) + f" {i}") for i in range(8)]
    texts = documents(spark, rows).select("text", (F.col("doc_id") % 2 + (F.col("doc_id") >= 1000).cast("int") > 0).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(texts)
    kept = [t for t, in texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) % toxicity.CALIBRATION_PART == 0).select("text").collect()]
    found = list(toxicity._segments(model.tokens, pa.array(kept)))
    want = sorted(model.calibration.evidence(n, [s for _, _, s in segments])[1] for n, segments, _ in found)
    assert np.allclose(sorted(seen[0][:, 1]), np.clip(want, -20, 60))


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, AWKWARD)
    assert toxicity.fit_toxicity(toxicity.labelled_texts(docs, none)) is None
    got = toxicity.score_toxicity(docs, None, ["doc_id"]).collect()
    assert len(got) == len(AWKWARD) and {r["score"] for r in got} == {0.0}
    some, labels = toxic_rows()
    model = toxicity.fit_toxicity(toxicity.labelled_texts(documents(spark, some), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    got = toxicity.score_toxicity(docs, model, ["doc_id"]).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] < 0.5 for r in got)


def test_extreme_value_law():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 2000, 4000)
    best = (np.log(0.3 * n) - np.log(-np.log(rng.random(4000)))) / 1.4
    scale, k = toxicity.extreme_value_law(n, best)
    assert abs(scale - 1.4) < 0.05 and abs(k - 0.3) < 0.05
    assert toxicity.extreme_value_law(np.zeros(0), np.zeros(0)) == (1.0, 0.1)


URLS = [
    "https://A.B.example.ORG/es/1?x=1#y", "http://example.org/en/12", "http://example.org/en/2", "http://org", "http://org/", "http://notorg.net/fr/",
    "x://shop.com/fr/a", "x://com/de/", "x://shop.com/DE/", "no scheme", "", None, "a://b://c/d", "://", "http://h\n.org/p\nq?z", "http://u:p@h.org:80/", "http://example.org?es/",
    "http://a.net/very/long-path_here/12345.html?a=1&b=2&&c", "http://a.net/very/long-path_here/12345.html?a=1&b=2&&c",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark):
    rng = random.Random(4)
    urls = URLS + [f"http://{rng.choice('abc')}{i}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'es', 'en'])}/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({n: F.lit("other") for n in ("host", "path", "rule", "score", "features", "label", "cell_1")})
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == (rule.verdict if rule else ("block" if r["score"] >= 0.5 else "allow"))
    ruled = [(plain_rule(*plain_parts(u)), got[i]["score"]) for i, u in enumerate(urls)]
    right = [(s >= 0.5) == (r.verdict == "block") for r, s in ruled if r]
    assert sum(right) >= 0.8 * len(right)


def test_urls_with_one_class_or_none(spark):
    def verdicts(urls, rules):
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
        return sorted(r["verdict"] for r in url_filter.filter_urls(pages, rules).collect())

    assert verdicts(["http://a.net/", None], []) == ["allow", "allow"]
    assert verdicts(["http://a.net/", "http://b.com/"], [url_filter.Rule("block", "com", "/")]) == ["block", "block"]
    assert verdicts([], URL_RULES) == []


def test_entropy_and_features(spark):
    row = spark.createDataFrame([("http://aab.net/x1/?p=1&q=2#f",)], "url string").withColumns({"host": F.lit("aab.net"), "path": F.lit("/x1/")})
    r = url_filter.lexical_features(row).first()
    url = r["url"]
    shares = [url.count(c) / len(url) for c in set(url)]
    assert r["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert (r["n_parameters"], r["path_depth"], r["host_depth"], r["has_fragment"]) == (2, 1, 2, 1)


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = [*AWKWARD, (20, "a b c a b c a b c d"), (21, "l one\nl one\n\n \nl one\r\nl one"), (22, "x x x x"), (23, prose(1, 90) + "\n" + prose(1, 60)), (24, "#*$%&|<> 𝔘#")]
    got = quality_rules.judge_quality(clashing(documents(spark, rows))).collect()
    have = sorted(((r["doc_id"], *(r[c] for c in quality_rules.BASE), r["base_failed"]) for r in got), key=str)
    want = []
    for k, t in rows:
        base = plain_base(t)
        want.append((k, *base, base[0] < 50 or 100 * base[4] > 50 * base[0]))
    assert have == sorted(want, key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.judge_quality(documents(spark, [])).count() == 0


def test_quality_verdicts(spark):
    rng = random.Random(8)
    good = [(i, "\n".join(prose(i * 10 + j, 40) for j in range(1 + i % 5)) + "\n" + prose(i + 5000, 40)) for i in range(150)]
    junk = []
    for i in range(24):
        words = prose(900 + i, 100).split()
        junk.append((1000 + i, " ".join(w + rng.choice(["%%%", "###"]) for w in words) if i % 2 else " | ".join(words)))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(documents(spark, good + junk)).collect()}
    assert all(got[i] for i, _ in good)
    assert not any(got[i] for i, _ in junk)


def test_em_finds_planted_accuracies():
    rng = random.Random(6)
    accuracy = [(0.95, 0.4), (0.99, 0.7), (0.9, 0.6)]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(None if rng.random() < 0.1 else int((rng.random() < a) if good else (rng.random() >= b)) for a, b in accuracy)
        counts[votes] = counts.get(votes, 0) + 1
    model = quality_rules.fit(sorted(counts.items(), key=str), 3, rounds=300)
    assert abs(model["good"] - 0.8) < 0.06
    assert all(abs(m - a[0]) < 0.05 for m, a in zip(model["for_good"], accuracy, strict=True))
    assert all(abs(m - a[1]) < 0.12 for m, a in zip(model["against_bad"], accuracy, strict=True))
    empty = quality_rules.fit([], 3)
    assert empty["for_good"] == pytest.approx([quality_rules.FOR_GOOD] * 3)


def test_registered_models(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    lang = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, data).collect()}
    assert lang.keys() == ids and all(r["held_out"] == (crc(k) % 4 == 2) for k, r in lang.items())
    true = dict(docs.select("doc_id", "lang").collect())
    held = [true[k] == r["lang_pred"] for k, r in lang.items() if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    tox = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, data).collect()}
    assert tox.keys() == ids and all(r["held_out"] == (crc(k) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for k, r in tox.items())
    assert all(r["verdict"] in ("allow", "block") for r in QUERIES["op2_url_filter"](spark, data).collect())
    quality = QUERIES["op9_quality_rules"](spark, data).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(plain_base(texts[r["doc_id"]]) == tuple(r[c] for c in quality_rules.BASE) for r in quality)
