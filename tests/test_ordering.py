"""Exact ranks and quantiles against pandas, with ties, hot groups and missing keys."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from permeon.functions.draws import draw, unit_draw
from permeon.operators.dedup import top_k
from permeon.operators.ordering import hot_groups, quantile_cuts, ranked, ranked_by_draw, running_totals, with_order_bucket
from permeon.operators.quantiles import exact_quantiles
from permeon.operators.sampling import sample_n


def skewed(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 3, n), 2))  # one value holds 40 %
    group = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 50, n).astype(str))
    return pd.DataFrame({"id": rng.permutation(n), "g": group, "v": value})


@pytest.mark.parametrize("hot_rows", [None, 300])
@pytest.mark.parametrize("up", [[True, True], [False, True], [True, False]])
def test_ranks_with_ties_and_hot_groups(spark, up, hot_rows):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = ranked(df, ["v", "id"], by=["g"], name="pos", ascending=up, total="n", hot_rows=hot_rows).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=up)
    want["pos"] = want.groupby("g").cumcount()
    both = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(both) == len(pdf) and (both["pos"] == both["pos_want"]).all()
    assert (got.groupby("g")["pos"].count() == got.groupby("g")["n"].first()).all()


def test_heavy_values_are_cut_by_the_next_key(spark):
    df = spark.createDataFrame(skewed())
    cuts = quantile_cuts(df, ["v", "id"], pieces=32)
    assert len(cuts.bounds) > 20 and sum(b[0] == 5.0 for b in cuts.bounds) > 5
    coded = with_order_bucket(df, ["v", "id"], [True, True], cuts, "b")
    assert coded.groupBy("b").count().agg(F.max("count")).first()[0] < 600


def test_missing_keys_come_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, None)], "id int, v double")
    for up, first in ((True, 3), (False, 2)):
        got = {r["id"]: r["pos"] for r in ranked(df, ["v", "id"], name="pos", ascending=[up, True]).collect()}
        assert got[first] == 0 and got[1] == 2 and got[4] == 3


@pytest.mark.parametrize("hot_rows", [None, 1, 0])
def test_null_groups_are_kept(spark, hot_rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = {r["v"]: r["pos"] for r in ranked(df, "v", by=["g"], name="pos", hot_rows=hot_rows).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_only_hot_groups_are_cut(spark):
    df = spark.createDataFrame(skewed())
    assert [r["g"] for r in hot_groups(df, ["g"], 300).collect()] == ["hot"] and hot_groups(df, ["g"]).isEmpty()


def test_running_totals(spark):
    pdf = skewed(1000)
    df = spark.createDataFrame(pdf).withColumn("w", F.col("id") % 10)
    got = running_totals(df, ["id"], {"upto": F.col("w")}, totals={"upto": "all"}).toPandas().sort_values("id")
    assert (got["upto"] == (got["id"] % 10).cumsum()).all() and (got["all"] == 4500).all()


KEYS = {
    "big": "CAST(1152921504606846976 + id AS bigint)",
    "price": "CAST(pmod(id * 7919, 1000) AS decimal(20,3)) / 8",
    "name": "concat('n', pmod(id * 31, 500), '-', id)",
    "day": "date_add(DATE'2020-01-01', CAST(pmod(id * 13, 300) AS int))",
    "time": "timestamp_seconds(1600000000 + pmod(id * 17, 900))",
    "flag": "pmod(id, 2) = 0",
    "real": "CASE WHEN pmod(id, 50) = 0 THEN double('NaN') WHEN pmod(id, 51) = 0 THEN NULL ELSE pmod(id * 29, 700) / 3 END",
}


@pytest.mark.parametrize("hot_rows", [None, 100])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("key", sorted(KEYS))
def test_keys_of_every_type(spark, key, up, by, hot_rows):
    if hot_rows and not by:
        pytest.skip("an ungrouped order is always cut")
    df = spark.range(3000).selectExpr(f"{KEYS[key]} AS k", "id", "IF(pmod(id, 3) = 0, 'hot', CAST(pmod(id, 40) AS string)) AS g")
    sort = F.col("k").asc_nulls_last() if up else F.col("k").desc_nulls_last()
    want = df.withColumn("want", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy(sort, "id")) - 1)
    got = ranked(want, ["k", "id"], by=by, name="pos", ascending=[up, True], hot_rows=hot_rows)
    assert got.filter("pos <> want").count() == 0 and got.count() == 3000


def test_many_tied_keys(spark):
    df = spark.range(2000).selectExpr("1 AS a", "'x' AS b", "CAST(2 AS decimal(5,2)) AS c", "NULL AS d", "id")
    order = ["a", "b", "c", "d", "id"]
    cuts = quantile_cuts(df, order, pieces=16)
    assert with_order_bucket(df, order, [True] * 5, cuts, "n").select("n").distinct().count() >= 12
    assert ranked(df, order, name="pos").filter("pos <> id").count() == 0


def test_top_k_and_sample_have_one_order(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (2, 5.0, None), (3, 5.0, "a"), (4, None, "a"), (5, 7.0, "c")], "id int, v double, t string")
    for k in (1, 3, 5, 10**6):
        assert [r["id"] for r in top_k(df, "v", k, ["t"]).collect()] == [5, 3, 1, 2, 4][:k]
    few, all_rows = ([r["id"] for r in sample_n(df, "id", n).collect()] for n in (3, 10**6))
    assert few == all_rows[:3] and sorted(all_rows) == [1, 2, 3, 4, 5]


def test_text_ties(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (0.5, "z")], "v double, t string")
    assert [r["t"] for r in ranked(df, ["v", "t"], name="p").orderBy("p").collect()] == ["z", "a", "b"]


def test_draws_are_uniform_and_stable(spark):
    df = spark.range(20000).select("id", draw(42, "id").alias("d"), unit_draw(42, "id").alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("d")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and r[3] == 20000
    a = ranked_by_draw(df, "d", "id", name="p").select("id", "p")
    b = ranked_by_draw(df.repartition(3), "d", "id", name="p").select("id", "p")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("leaf", [10, 4096])
def test_quantiles_match_pandas(spark, monkeypatch, leaf):
    monkeypatch.setattr("permeon.operators.quantiles.LEAF_ROWS", leaf)
    pdf = skewed(6000)
    pdf["w"] = np.random.default_rng(3).lognormal(0, 4, len(pdf))
    pdf["few"] = pdf["id"] % 3
    probs = [0.0, 0.001, 0.25, 0.5, 0.6, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), ["v", "w", "few"], probs)
    for c in got:
        assert got[c] == pytest.approx(list(pdf[c].quantile(probs)), rel=1e-12), c


def test_quantiles_skip_what_is_no_number(spark):
    rows = [(1.0, None), (2.0, None), (10.0, None), (float("nan"), None), (float("inf"), None), (None, None)]
    df = spark.createDataFrame(rows, "x double, none double")
    assert exact_quantiles(df, ["x", "none"], [0.5]) == {"x": [2.0], "none": [None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [p])["x"][0] == pytest.approx(float(pd.Series(values).quantile(p)), abs=1e-9)
