"""Spark ML wrappers: they learn, persist, tune, and explain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon.operators import models, sampling, scoring
from permeon.operators.evaluation import metrics
from permeon.operators.features import fit_array_scaler
from permeon.plans.training import prepare, train_and_evaluate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(0, 1, (400, 4))
    x[:, 1] += 2.5 * y
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, x array<double>, y int").persist()


@pytest.fixture(scope="module")
def frame(rows):
    return models.as_vectors(sampling.stratified_folds(rows, "id", "y", 3), "x", "y", ["id", "fold"]).persist()


def accuracy(scores):
    return metrics(scores.select(F.col("label").cast("int").alias("actual"), "pred")).first()["accuracy"]


@pytest.mark.parametrize("name", ["LR", "RF", "ET", "GBT", "SVM", "MLP"])
def test_families_learn(frame, name):
    est = models.default_zoo(400, 4)[name]
    scores = scoring.score_models(frame, "id", {name: est.fit(frame)}, keep=["label"])
    assert accuracy(scores) > 0.8
    assert (scores.filter("p1 is null").count() == 400) == (name == "SVM")


def test_answers_share_one_scan(frame):
    zoo = models.default_zoo(400, 4)
    fitted = {n: zoo[n].fit(frame) for n in ("LR", "RF")}
    long = scoring.score_models(frame, "id", fitted)
    assert long.count() == 800
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_radial_kernel_is_approximated(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    z = np.stack([r["x"] for r in models.fourier_features(df, "x", 3, 4000, 0.3).orderBy("id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_tuning_and_search(frame):
    tuned = models.tune(models.forest(5, 2), {"maxDepth": [1, 4]}, frame, folds=3)
    table = models.tuning_table(tuned)
    assert len(table) == 2 and table[0][1] >= table[1][1] and tuned.bestModel.transform(frame).count() == 400
    space = {"maxDepth": lambda r: int(r.integers(1, 5))}
    a, b = (models.tuning_table(models.sampled_search(models.forest(5), space, 2, frame, folds=3)) for _ in range(2))
    assert a == b


def test_out_of_fold_covers_every_row(frame):
    oof = models.oof_predict(models.logreg(400, max_iter=20), frame, "id", folds=3)
    assert oof.count() == 400 and oof.select("id").distinct().count() == 400 and accuracy(oof) > 0.8


def test_bundle_survives_a_damaged_model(spark, rows, frame, tmp_path):
    fitted = {"LR": models.logreg(400, max_iter=5).fit(frame), "RF": models.forest(3, 2).fit(frame)}
    bundle = models.ModelBundle(fitted, ["a", "b", "c", "d"], fit_array_scaler(rows, "x"))
    models.save_bundle(spark, bundle, str(tmp_path))
    back = models.load_bundle(spark, str(tmp_path))
    assert back.features == bundle.features and back.scaler == bundle.scaler and not back.errors
    same = scoring.score_models(frame, "id", back.models).exceptAll(scoring.score_models(frame, "id", fitted))
    assert same.count() == 0
    for part in (tmp_path / "models" / "RF" / "metadata").glob("part-*"):
        part.write_text("broken")
    broken = models.load_bundle(spark, str(tmp_path))
    assert set(broken.models) == {"LR"} and set(broken.errors) == {"RF"}


def test_importances_find_the_signal(spark, frame):
    names = ["a", "signal", "c", "d"]
    for est in (models.forest(10, 3), models.logreg(400, max_iter=20)):
        assert models.importances(spark, est.fit(frame), names, 2).first()["feature"] == "signal"
    out = models.permutation_importance(models.forest(10, 3).fit(frame), frame, "id", names, share=0.5, repeats=3).collect()
    got = {r["feature"]: r["importance"] for r in out}
    assert len(got) == 4 and out[0]["feature"] == "signal" and got["signal"] > 0.1 > abs(got["c"])


def test_preparation_does_not_leak(rows):
    train, held, scaler = prepare(rows, "id", "x", "y")
    ids = {r["id"] for r in held.collect()}
    assert not ids & {r["id"] for r in train.collect()} and len(ids) == 80
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    leaky_train, leaky_held, _ = prepare(rows, "id", "x", "y", leaky=True)
    assert leaky_held.filter("id is null").count() > 0 and leaky_train.filter("id is null").count() > 0


def test_training_run(rows):
    run = train_and_evaluate(rows, "id", "x", "y", {"LR": models.logreg(400, max_iter=20), "RF": models.forest(10, 3)})
    board = run.board.collect()
    assert {r["model"] for r in board} == {"LR", "RF"} and board[0]["f1"] >= board[1]["f1"] and board[0]["roc_auc"] > 0.85


def test_neighbours_as_an_estimator(spark, tmp_path):
    """Fitted, tuned, saved and loaded like any model, and voted with others."""
    from pyspark.ml.functions import array_to_vector

    from permeon.operators.knn import KNNClassifier

    rows = spark.range(120).select(
        F.concat(F.lit("r"), "id").alias("key"),
        array_to_vector(F.array((F.col("id") % 10).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"),
        (F.col("id") % 10 >= 5).cast("double").alias("label"),
        (F.col("id") % 3).cast("int").alias("fold"),
    )
    train, test = rows.filter("fold > 0"), rows.filter("fold = 0")
    fitted = KNNClassifier(k=3, weights="distance", keyCol="key").fit(train)
    others = {"KNN": fitted, "GBT": models.boosted(5, max_depth=3).fit(train), "ET": models.extra_trees(10, 4).fit(train)}
    path = str(tmp_path / "bundle")
    models.save_bundle(spark, models.ModelBundle(others, ["a", "b"]), path)
    loaded = models.load_bundle(spark, path)
    assert loaded.errors == {}
    before, after = (scoring.score_models(test, "key", m, keep=["label"]).orderBy("key", "model").collect() for m in (others, loaded.models))
    assert before == after and len(after) == 3 * test.count()
    knn = [r for r in after if r["model"] == "KNN"]
    assert sum(r["pred"] == r["label"] for r in knn) == len(knn)
    tuned = models.tune(KNNClassifier(keyCol="key"), {"k": [1, 3]}, rows, folds=3)
    assert len(models.tuning_table(tuned)) == 2


def test_fits_get_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(500)
    many = models.in_few_tasks(rows.repartition(5 * cores), "id")
    assert many.rdd.getNumPartitions() <= 2 * cores and many.agg({"id": "sum"}).first()[0] == sum(range(500))
    assert models.in_few_tasks(rows.repartition(2), "id").rdd.getNumPartitions() == 2
