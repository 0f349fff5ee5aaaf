"""The radial-kernel machine: kernel values, probabilities, persistence."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from permeon.operators import models, scoring
from permeon.operators.kernel import KernelSVC, kernel, nystroem, platt_sigmoid


def rings(n, seed):
    """Two classes that no plane parts: an inner disc and a ring, with some noise."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    radius = np.where(y == 1, rng.normal(1.0, 0.35, n), rng.normal(2.2, 0.45, n))
    turn = rng.uniform(0, 2 * np.pi, n)
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], axis=1), y


def frame(spark, n, seed):
    x, y = rings(n, seed)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y int")
    return models.as_vectors(rows, "x", "y", ["id"]).coalesce(2).persist()


def auc(p, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


def test_landmark_features_have_the_kernels_dot_products():
    x, _ = rings(80, 1)
    got = kernel(x, x, 0.7) @ nystroem(x, 0.7)
    assert np.allclose(got @ got.T, kernel(x, x, 0.7), atol=1e-6)
    plain = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(kernel(x, x, 0.7), plain)
    few = kernel(x, x[:30], 0.7) @ nystroem(x[:30], 0.7)
    assert np.abs(few @ few.T - plain).mean() < 0.02


def test_sigmoid_recovers_planted_probabilities(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(int)
    a, b = platt_sigmoid(spark.createDataFrame(list(zip(m.tolist(), y.tolist(), strict=True)), "m double, y int"), "m", "y")
    assert a == pytest.approx(-1.5, abs=0.15) and b == pytest.approx(0.5, abs=0.15)
    # Separable margins still have a fit.
    a, b = platt_sigmoid(spark.createDataFrame([(float(i), int(i > 0)) for i in range(-20, 21) if i], "m double, y int"), "m", "y")
    assert np.isfinite([a, b]).all() and a < 0


def test_probabilities_are_calibrated_and_rank_well(spark, tmp_path):
    train, test = frame(spark, 400, 3), frame(spark, 800, 4)
    fitted = KernelSVC(keyCol="id", landmarks=60, maxIter=30).fit(train)
    rows = fitted.transform(test).select("label", "prediction", vector_to_array("probability")[1].alias("p")).collect()
    p, y = np.array([r["p"] for r in rows]), np.array([r["label"] for r in rows])
    assert not np.isnan(p).any() and auc(p, y) > 0.93
    linear = models.svm().fit(train).transform(test).select(vector_to_array("rawPrediction")[1].alias("m")).collect()
    assert auc(p, y) > auc(np.array([r["m"] for r in linear]), y) + 0.2
    for low, high in ((0, 0.25), (0.25, 0.75), (0.75, 1.01)):
        some = (p >= low) & (p < high)
        assert some.sum() > 20 and abs(p[some].mean() - y[some].mean()) < 0.12
    models.save_bundle(spark, models.ModelBundle({"SVM": fitted}, ["a", "b"]), str(tmp_path))
    back = models.load_bundle(spark, str(tmp_path))
    assert not back.errors
    before, after = (scoring.score_models(test, "id", m).orderBy("id").collect() for m in ({"SVM": fitted}, back.models))
    assert before == after


def test_rows_in_any_order_and_rows_without_features(spark):
    train = frame(spark, 200, 5)
    models_of = [KernelSVC(keyCol="id", landmarks=20, maxIter=10).fit(t) for t in (train, train.repartition(7).orderBy(F.desc("id")))]
    a, b = (m.state for m in models_of)
    assert np.array_equal(a["landmarks"], b["landmarks"]) and np.allclose(a["weights"], b["weights"], rtol=1e-3, atol=1e-4)
    asked = train.select("id", F.when(F.col("id") > 5, F.col("features")).alias("features"))
    assert models_of[0].transform(asked).where("prediction IS NULL AND probability IS NULL").count() == 6


def test_training_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(y):
        made.add(1)
        return y

    x, y = rings(300, 6)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y int")
    train = models.as_vectors(rows.repartition(20).withColumn("y", seen("y")), "x", "y", ["id"])
    KernelSVC(keyCol="id", landmarks=20, maxIter=5).fit(train)
    assert made.value <= 600
