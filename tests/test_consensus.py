"""Golden replicate groups, and independence from partitioning."""

import pytest
from pyspark.sql import functions as F

from permeon.operators.aggregates import drop_discordant, pack_replicates, pack_text, unpack_text
from permeon.operators.consensus import (
    drop_groups,
    label_consensus,
    numeric_consensus,
    pick_id,
    pick_name,
)
from permeon.plans.curation import curate

NUMERIC = {
    "single": ([0.5], "A", 0.5, 0.0),
    "close": ([1.00, 1.02], "B", 1.0, 0.0),
    "two": ([0.1, 0.3], "C", 0.2, 0.1),
    "mode": ([0.1, 0.1, 0.4], "D", 0.1, 0.141421),
    "three tied": ([0.1, 0.3, 0.5], "dropped_E", 0.3, 0.163299),
    "two of several tied": ([0.1, 0.1, 0.3, 0.3, 0.5], "dropped_F", 0.2, 0.149666),
    "two tied": ([0.1, 0.1, 0.4, 0.4], "dropped_G", 0.2, 0.15),
    "two decimals": ([0.25, 0.25, 0.47], "D", 0.25, 0.103709),
    "negative": ([-0.5, -0.52], "B", -0.5, 0.0),
    "negative half": ([-0.25, -0.2], "B", -0.2, 0.0),
    "many tied": ([0.1, 0.2, 0.3, 0.4], "dropped_E", 0.3, 0.111803),
    "whole": ([1.0, 1.0, 1.0], "B", 1.0, 0.0),
}


def test_numeric_groups(spark):
    rows = [(k, v) for k, (values, *_) in NUMERIC.items() for v in values] + [("wide", -0.5), ("wide", 0.6), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for shuffled in (df.coalesce(1), df.repartition(7, "v")):
        got = {r["k"]: r for r in numeric_consensus(shuffled, ["k"], "v").collect()}
        assert set(got) == set(NUMERIC)
        for k, (values, group, value, std) in NUMERIC.items():
            assert (got[k]["group"], got[k]["n"]) == (group, len(values)), k
            assert got[k]["value"] == pytest.approx(value, abs=1e-9), k
            assert got[k]["std"] == pytest.approx(std, abs=1e-6), k


def test_span_of_exactly_one_stays(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0)], "k string, v double")
    assert numeric_consensus(df, ["k"], "v").first()["group"] == "C"
    assert drop_discordant(df, ["k"], "v").count() == 2


def test_dropped_groups_go(spark):
    rows = [(k, v) for k, (values, *_) in NUMERIC.items() for v in values]
    kept = drop_groups(numeric_consensus(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"))
    assert {r["group"] for r in kept.collect()} == {"A", "B", "C", "D"}


LABELS = {
    "measured up": ([("BBB-", -1.0, None)], "BBB+", "A"),
    "measured down": ([("BBB+", -1.01, None)], "BBB-", "A"),
    "measured beats votes": ([("BBB-", None, -1.0), ("BBB-", None, -1.0), (None, 0.3, None)], "BBB+", "A"),
    "strict agree": ([("BBB+", None, -1.0), ("BBB+", None, -1.0)], "BBB+", "B"),
    "strict split": ([("BBB+", None, -1.0), ("BBB-", None, -1.0)], "", "dropped_group1"),
    "agree": ([("BBB-", None, None), ("BBB-", None, None)], "BBB-", "C"),
    "other threshold": ([("BBB-", None, 0.1), ("BBB-", None, 0.1)], "BBB-", "C"),
    "plurality": ([("BBB+", None, None), ("BBB+", None, None), ("BBB-", None, None)], "BBB+", "D"),
    "tie": ([("BBB+", None, None), ("BBB-", None, None)], "", "dropped_group2"),
}


def test_label_groups(spark):
    rows = [(k, *r) for k, (members, *_) in LABELS.items() for r in members]
    df = spark.createDataFrame(rows, "k string, label string, v double, t double")
    got = {r["k"]: (r["label"], r["group"]) for r in label_consensus(df, ["k"], "label", "v", "t").collect()}
    assert got == {k: (label, group) for k, (_, label, group) in LABELS.items()}


def test_curate_uses_measurements_first(spark):
    rows = [
        ("a", 0.5, "BBB-", None),
        ("a", None, "BBB-", None),
        ("b", None, "BBB-", None),
        ("c", 0.0, None, None),
        ("c", 2.0, None, None),  # discordant, so its vote decides
        ("c", None, "BBB+", None),
        ("d", -10.0, None, None),  # below the floor, and nothing else
        ("e", None, "BBB+", None),
        ("e", None, "BBB-", None),
    ]
    df = spark.createDataFrame(rows, "k string, v double, label string, t double")
    got = {r["k"]: (r["value"], r["label"], r["group"]) for r in curate(df, "k", "v", "label", "t").collect()}
    assert got == {"a": (0.5, "BBB+", "A"), "b": (None, "BBB-", "C"), "c": (None, "BBB+", "C")}


def test_names_and_ids(spark):
    rows = [
        ("a", "nan", "Zeta", "iso-a", "nan"),
        ("a", " Beta", "Alpha", "iso-b", "12.0"),
        ("b", "123", "x", "iso-c", "7"),
        ("b", None, "nan", "iso-d", "bad"),
        ("c", None, None, "9", None),
    ]
    df = spark.createDataFrame(rows, "k string, pref string, other string, alt string, cid string")
    names = pick_name(df, ["k"], "pref", "other", "alt", ["alt"], drop_single=True)
    assert {r["k"]: r["picked_name"] for r in names.collect()} == {"a": "beta", "b": "iso-c", "c": ""}
    ids = pick_id(df, ["k"], "cid")
    assert {r["k"]: r["picked_id"] for r in ids.collect()} == {"a": 12, "b": 7, "c": None}


def test_packs_are_whole_and_bounded(spark):
    hot = spark.range(2500).select(F.lit("hot").alias("k"), "id", (F.col("id") % 7).alias("v"))
    cold = spark.range(30).select(F.concat(F.lit("c"), F.col("id")).alias("k"), "id", F.lit(None).cast("bigint").alias("v"))
    packed = pack_replicates(hot.unionByName(cold), ["k"], ["id", "v"], ["id"], pack_size=1000).persist()
    sizes = sorted((r["pack"], r["n"]) for r in packed.filter("k = 'hot'").collect())
    assert sizes == [(0, 1000), (1, 1000), (2, 500)]
    back = packed.select("k", "pack", F.posexplode("id").alias("p", "id")).filter("k = 'hot'")
    assert back.filter(F.col("pack") * 1000 + F.col("p") != F.col("id")).count() == 0
    assert packed.filter("k <> 'hot'").filter(F.get("v", F.lit(0)).isNull() & (F.size("v") == 1)).count() == 30
    text = packed.filter("k = 'c3'").select(pack_text(F.col("id")).alias("t")).select("t", unpack_text(F.col("t")).alias("u"))
    assert tuple(text.first()) == ("3", ["3"])
