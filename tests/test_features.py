"""Feature preparation, splits and folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permeon.functions import cleaning, labels, rounding
from permeon.functions.draws import draw
from permeon.operators import distribution, features, sampling


def wide(spark, n=400):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(5, 2, n), "b": rng.lognormal(0, 3, n), "flat": 3.0})
    return spark.createDataFrame(pdf).repartition(3), pdf


def test_sanitize(spark):
    rows = [(1.0, None), (3.0, None), (float("inf"), None), (None, None), (float("nan"), None)]
    got = features.sanitize(spark.createDataFrame(rows, "x double, none double"), ["x", "none"]).collect()
    assert sorted(r["x"] for r in got) == [1.0, 2.0, 2.0, 2.0, 3.0] and {r["none"] for r in got} == {0.0}


def test_impute_and_clip(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,), (float("nan"),), (2e7,)], "x double")
    assert [r[0] for r in features.impute_const(df, ["x"], 0.0, 1e6, -1e6).collect()] == [1e6, -1e6, 0, 0, 2e7]
    clipped = features.hard_clip(df, ["x"]).collect()
    assert clipped[0][0] == 1e6 and clipped[2][0] is None and clipped[4][0] == 1e6


def test_winsorize(spark):
    df, pdf = wide(spark)
    df = df.withColumn("none", F.lit(None).cast("double"))
    got = features.winsorize(df, ["b", "none"], (0.1, 0.9)).agg(F.min("b"), F.max("b"), F.max("none")).first()
    assert tuple(got) == pytest.approx((pdf["b"].quantile(0.1), pdf["b"].quantile(0.9), 0.0))
    rough = features.winsorize(df, ["b"], (0.1, 0.9), exact=False).agg(F.max("b")).first()[0]
    assert rough == pytest.approx(pdf["b"].quantile(0.9), rel=0.1)


def test_variance_exactly_at_the_limit_goes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "q double, big double")  # variances 0.25 and 1
    assert features.variance_filter(df, ["q", "big"], 0.25) == ["big"]


def test_scalers(spark):
    df, pdf = wide(spark)
    scaler = features.fit_scaler(df, ["a", "b", "flat"])
    got = features.apply_scaler(df, scaler).toPandas()
    assert got[["a", "b"]].mean().abs().max() < 1e-9 and got["a"].std(ddof=0) == pytest.approx(1)
    assert (got["flat"] == 0).all()
    assert features.apply_scaler(df, None) is df
    packed = df.select(F.array("a", "b", "flat").alias("f"))
    wide_scaler = features.fit_array_scaler(packed, "f")
    assert wide_scaler.means == pytest.approx(scaler.means) and wide_scaler.stds == pytest.approx(scaler.stds)


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 5)) * [5, 3, 1, 0.5, 0.1] + 10
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, f array<double>")
    out = features.pca(df, "f", 2, standardise=False)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = out.rows.orderBy("id").toPandas()
    want = (x - x.mean(0)) @ v[:2].T
    assert np.allclose(np.abs(got[["pc1", "pc2"]]), np.abs(want)) and abs(got["pc1"].mean()) < 1e-9
    assert out.explained == pytest.approx(tuple((s**2 / (s**2).sum())[:2]))


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "b a b a"), (2, "A b, a b!"), (3, "123"), (4, None), (5, "a")], "id int, t string")
    got = {r["id"]: r["bits"] for r in features.fingerprint(df, "t").collect()}
    assert got[3] == got[4] == [] and len(got[5]) == 1 and set(got[5]) <= set(got[1]) and got[1] == got[2]
    vectors = {r["id"]: r["features"] for r in features.fingerprint_vector(df, "t").collect()}
    assert vectors[1].size == 2048 and vectors[3].numNonzeros() == 0 and set(vectors[1].values) == {1.0}


def test_featurize_isolates_failures(spark):
    def fn(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": [1.0 / len(k) for k in keys]})

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "abcd")], "id int, k string").coalesce(1)
    got = {r["id"]: (r["n"], r["failed"]) for r in features.featurize(df, "k", fn, ["n"], keep=["id"]).collect()}
    assert got[1] == (0.5, False) and got[3] == (0.25, False) and got[2][1] is True and got[2][0] is None


def test_structure_screens(spark):
    df = spark.createDataFrame([(1, "CC(=O)Cl[Na+]Br"), (2, "C[Hg]C"), (3, "CCO.Cl"), (4, "[13CH4]c1ccccc1")], "id int, k string")
    from permeon.functions.text import HEAVY_ELEMENTS, element_tokens

    got = {r["id"]: set(r["t"]) for r in df.select("id", element_tokens("k").alias("t")).collect()}
    assert got[1] == {"C", "O", "Cl", "Na", "Br"} and got[4] == {"C"}
    assert len(HEAVY_ELEMENTS) == 98 - 5
    assert {r["id"] for r in features.element_screen(df, "k", HEAVY_ELEMENTS).collect()} == {1, 3, 4}
    assert {r["k"] for r in features.keep_largest_part(df.filter("id = 3"), "k").collect()} == {"CCO"}
    blank = spark.createDataFrame([(" A  b\n", None), (" ", "x")], "k string, comments string")
    assert [r["canonical_key"] for r in features.canonicalize(blank, "k").collect()] == ["a b"]
    noted = features.note_failures(blank.withColumn("k", F.when(F.col("k") != " ", F.col("k"))), "k", "comments").collect()
    assert [r["comments"] for r in noted] == [None, "x|error of generating inchi"]


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = sampling.stratified_split(df, "id", "y", 0.25)
    n = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert n == {(0, "test"): 167, (0, "train"): 501, (1, "test"): 84, (1, "train"): 251}
    assert a.exceptAll(sampling.stratified_split(df.repartition(5), "id", "y", 0.25)).count() == 0
    three = {r["split"]: r["count"] for r in sampling.three_way_split(df, "id").groupBy("split").count().collect()}
    assert three == {"train": 803, "valid": 100, "test": 100}
    folds = sampling.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().toPandas()
    assert len(folds) == 10 and (folds.groupby("y")["count"].max() - folds.groupby("y")["count"].min()).max() <= 1
    few = {r["id"] for r in sampling.sample_n(df, "id", 10).collect()}
    assert few == {r["id"] for r in sampling.sample_n(df.repartition(4), "id", 10).collect()} and len(few) == 10


def test_samples_of_any_size_are_the_first_draws(spark):
    df = spark.range(500)
    want = [r["id"] for r in df.orderBy(draw(sampling.SEED, "id"), "id").collect()]
    for n in (0, 1, 120, 500, 10**6):
        assert [r["id"] for r in sampling.sample_n(df, "id", n).collect()] == want[:n]


def test_histogram_and_ecdf(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2, 10]] + [(None,)], "x double")
    got = {r["bin"]: r["n"] for r in distribution.histogram(df, "x", 5).collect()}
    assert got == {0: 3, 1: 1, 2: 0, 3: 0, 4: 1}
    same = distribution.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 2)
    assert sum(r["n"] for r in same.collect()) == 2
    steps = [r["proportion"] for r in distribution.ecdf(df, "x").orderBy("x").collect()]
    assert steps == pytest.approx([0.4, 0.6, 0.8, 1.0])


def test_scalar_functions(spark):
    df = spark.createDataFrame([("1.5", 0), ("x", 1), (None, None)], "s string, y int")
    assert [r[0] for r in df.select(cleaning.coerce_number("s")).collect()] == [1.5, 0.0, 0.0]
    assert [r[0] for r in df.select(labels.decode_vote("y")).collect()] == ["BBB-", "BBB+", "N/A"]
    assert [r[0] for r in df.select(labels.map_lookup("s", {"x": 9})).collect()] == [None, 9, None]
    half = spark.createDataFrame([(25, 10), (35, 10), (-25, 10), (-35, 10), (26, 10), (-24, 10), (7, 7)], "a bigint, b bigint")
    assert [r[0] for r in half.select(rounding.halves_even_div(F.col("a"), F.col("b"))).collect()] == [2, 4, -2, -4, 3, -2, 1]
    texts = spark.createDataFrame([(["1.25", "2", "3.5"],), (["1.25", "0.5"],)], "a array<string>")
    assert [r[0] for r in texts.select(rounding.min_scale("a")).collect()] == [0, 1]
    edges = spark.createDataFrame([(9.9,), (10.0,), (25.0,), (None,)], "v double")
    assert [r[0] for r in edges.select(labels.uncertainty_band("v")).collect()] == ["low", "medium", "high", None]
    conf = spark.createDataFrame([(80.0,), (80.1,), (60.0,), (59.9,)], "v double")
    assert [r[0] for r in conf.select(labels.confidence_band("v")).collect()] == ["medium", "high", "medium", "low"]


def test_user_featuriser_gets_batches_of_bounded_bytes(spark):
    rows = spark.range(6000, numPartitions=1).select("id", F.repeat(F.lit("long text "), 300).alias("text"))
    sizes = lambda keys: pd.DataFrame({"bytes": [float(keys.str.len().sum())] * len(keys)})
    found = features.featurize(rows, "text", sizes, ["bytes"], keep=["id"]).agg(F.count("*").alias("n"), F.max("bytes").alias("top")).first()
    assert found["n"] == 6000 and found["top"] <= 5 << 20


def test_user_featuriser_keeps_no_batch(spark):
    """Each batch ends up in a cycle (``keys.str`` is cached on the keys); none may outlive the next."""
    import gc
    import weakref

    rows = spark.range(6000, numPartitions=1).select("id", F.repeat(F.lit("long text "), 300).alias("text"))
    seen = []

    def alive(keys):
        gc.disable()  # only what the operator does counts
        keys.str.lower()
        seen.append(weakref.ref(keys))
        gc.enable()
        return pd.DataFrame({"alive": [float(sum(r() is not None for r in seen))] * len(keys)})

    found = features.featurize(rows, "text", alive, ["alive"], keep=["id"]).agg(F.count_distinct("alive").alias("n"), F.max("alive").alias("top")).first()
    assert found["top"] <= 2
