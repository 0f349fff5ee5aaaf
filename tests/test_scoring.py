"""Ensemble flavours, batch scoring, display and evaluation on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon.operators import evaluation, scoring
from permeon.operators.aggregates import batch_summary
from permeon.plans.batch_scoring import order_for_display, resolve_inputs, score_batch
from permeon.plans.display import format_results


@pytest.fixture(scope="module")
def votes(spark):
    rows = [
        ("half", "A", 1, 0.7), ("half", "B", 0, 0.3),
        ("all", "A", 1, 0.9), ("all", "B", 1, 0.8), ("all", "C", 1, 0.7),
        ("none", "A", 0, 0.1), ("none", "B", 0, 0.2),
        ("one", "A", 0, 0.2),
        ("mute", "A", 1, None), ("mute", "B", 0, None), ("mute", "C", 0, None),
        ("mix", "A", 1, 0.9), ("mix", "B", 1, None), ("mix", "XGB", 0, 0.4),
    ]
    return spark.createDataFrame(rows, "id string, model string, pred int, p1 double").persist()


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_mean_of_exactly_half_is_negative(votes):
    got = by_id(scoring.ensemble_mean(votes, "id"))
    assert got["half"]["prediction"] == "BBB-" and got["half"]["agreement"] == 50
    assert got["half"]["uncertainty"] == pytest.approx(20)
    assert got["all"]["confidence"] == pytest.approx(80) and got["none"]["agreement"] == 100
    assert got["none"]["confidence"] == pytest.approx(85)


def test_batch_vote(votes):
    got = by_id(scoring.ensemble_vote_batch(votes, "id"))
    assert got["half"]["prediction"] == "BBB+" and got["half"]["agreement"] == 50
    assert got["none"]["confidence"] == pytest.approx(15)  # P(positive), not of the winner
    assert (got["one"]["confidence"], got["one"]["uncertainty"]) == (pytest.approx(20), pytest.approx(30))
    assert (got["mute"]["confidence"], got["mute"]["uncertainty"]) == (50, 0)
    assert got["mute"]["agreement"] == pytest.approx(100 * 2 / 3)
    assert got["mix"]["num_models"] == 3 and got["mix"]["uncertainty"] == pytest.approx(25)


def test_row_vote_equals_grouped_vote(votes):
    answers = votes.groupBy("id").agg(F.collect_list(F.struct("model", "pred", "p1")).alias("answers"))
    row = by_id(answers.select("id", *[e.alias(n) for n, e in scoring.vote_on_row("answers").items()]))
    grouped = by_id(scoring.ensemble_vote_batch(votes, "id"))
    for k in grouped:
        for c in ("confidence", "uncertainty", "agreement"):
            assert row[k][c] == pytest.approx(grouped[k][c]), (k, c)
        assert (row[k]["prediction"], row[k]["num_models"]) == (grouped[k]["prediction"], grouped[k]["num_models"])


def test_agreeing_vote(votes):
    got = by_id(scoring.ensemble_vote_agree(votes, "id"))
    assert got["half"]["confidence"] == pytest.approx(70) and got["none"]["confidence"] == pytest.approx(85)
    assert got["mix"]["confidence"] == pytest.approx(90) and got["mute"]["confidence"] == 50


def test_count_majority_primary(votes):
    got = by_id(scoring.ensemble_count(votes, "id"))
    assert got["half"]["prediction"] == "BBB+" and got["mute"] == {"id": "mute", "prediction": "BBB-", "confidence": 0.0}
    need = by_id(scoring.majority(votes, "id", 2))
    assert need["half"]["prediction"] == "BBB-" and need["mix"]["prediction"] == "BBB+"
    first = by_id(scoring.primary_score(votes, "id"))
    assert first["mix"]["model"] == "XGB" and first["mix"]["confidence"] == pytest.approx(60)
    assert first["all"]["model"] == "A" and first["all"]["confidence"] == pytest.approx(90)


def test_wide_majority_and_model_table(spark, votes):
    wide = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 0, 0, 1, None)], "a int, b int, c int, d int, e int")
    assert [r["final"] for r in scoring.majority_wide(wide, list("abcde")).collect()] == [1, 0]
    table = {(r["id"], r["model"]): r["confidence"] for r in scoring.model_table(votes, "id").collect()}
    assert table[("mute", "A")] == "N/A" and table[("none", "A")] == "90.0"


def test_softmax_head(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 800.0]), (2, [3.0, -900.0])], "id int, z array<double>")
    got = {r["id"]: r for r in scoring.softmax_head(df, F.col("z")).collect()}
    assert (got[0]["prediction"], got[0]["confidence"], got[0]["reliable"]) == (0, 0.5, False)
    assert (got[1]["prediction"], got[1]["confidence"], got[1]["permeable"]) == (1, 1.0, True)
    assert sum(got[2]["probabilities"]) == 1 and not got[2]["permeable"]


def test_score_batch_routes_errors(spark):
    batch = spark.createDataFrame(
        [(1, "C1", "one"), (2, "aspirin", "two"), (3, "nothing", "three"), (4, "C9", "four"), (5, None, "five")],
        "id int, input string, name string",
    )
    lookup = spark.createDataFrame([("Aspirin", "C2"), ("aspirin", "C3")], "name string, smiles string")
    feats = spark.createDataFrame([("C1", "2.0"), ("C2", "-1")], "smiles string, x string")
    calls = {
        "up": lambda: (F.when(F.col("x") > 0, 1).otherwise(0), 1 / (1 + F.exp(-F.col("x")))),
        "flat": lambda: (F.lit(1), F.lit(None)),
    }
    out = score_batch(
        batch,
        "id",
        lambda b: resolve_inputs(b, lambda c: c.rlike("^C[0-9]$"), "mixed", lookup, lookup_order=["smiles"]),
        lambda r: r.join(feats, "smiles", "left").withColumn("failed", F.col("x").isNull()),
        calls,
        ["x"],
    )
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["Success", "Success", "Error", "Error", "Error"]
    assert got[2]["smiles"] == "C2" and got[2]["prediction"] == "BBB+" and got[2]["agreement"] == 50
    assert got[3]["error"] == "Could not process molecule" and got[4]["error"] == "Descriptor calculation failed"
    assert got[4]["prediction"] is None and got[4]["confidence"] is None
    assert [r["id"] for r in order_for_display(out, "id").collect()] == [3, 4, 5, 1, 2]


def test_summary_is_zero_guarded(spark):
    schema = "status string, prediction string, confidence double, uncertainty double, agreement double"
    empty = batch_summary(spark.createDataFrame([], schema)).first()
    assert (empty["total"], empty["success_rate"], empty["positive_rate"], empty["avg_confidence"]) == (0, 0, 0, 0)
    rows = [("Success", "BBB+", 80.0, 4.0, 100.0), ("Success", "BBB-", None, 2.0, 60.0), ("Error", None, None, None, None)]
    got = batch_summary(spark.createDataFrame(rows, schema)).first()
    assert (got["positive_rate"], got["avg_confidence"], got["avg_agreement"]) == (50, 40, 80)


def test_display_keeps_zero(spark):
    rows = [(1, "in", None, "Success", None, "BBB+", 0.0, None, 62.25, 300.04, 1.005, "CC"), (2, "x", "n", "Error", None, None, None, None, None, None, None, None)]
    schema = "id int, input string, name string, status string, error string, prediction string, confidence double, uncertainty double, agreement double, molecular_weight double, logp double, smiles string"
    got = {r["id"]: r for r in format_results(spark.createDataFrame(rows, schema), "id").collect()}
    assert (got[1]["Confidence"], got[1]["Uncertainty"], got[1]["Agreement"], got[1]["Error"]) == ("0.0", "N/A", "62.2", None)
    assert (got[2]["Prediction"], got[2]["SMILES"], got[2]["Error"]) == ("N/A", "N/A", "Unknown error")


def auc_by_pairs(actual, score):
    pos, neg = score[actual == 1], score[actual == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def ap_by_steps(actual, score):
    total, out, last = (actual == 1).sum(), 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        above = score >= t
        recall = (actual[above] == 1).sum() / total
        out += (recall - last) * (actual[above] == 1).mean()
        last = recall
    return out


@pytest.mark.parametrize("decimals", [1, 6])
def test_ranking_metrics(spark, decimals):
    rng = np.random.default_rng(2)
    actual = rng.integers(0, 2, 500)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * actual, 0.25), 0, 1), decimals)  # heavy ties at one decimal
    df = spark.createDataFrame([(int(a), float(s)) for a, s in zip(actual, score)], "actual int, score double").repartition(4)
    got = evaluation.ranking_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(auc_by_pairs(actual, score))
    assert got["average_precision"] == pytest.approx(ap_by_steps(actual, score))
    mirrored = evaluation.roc_auc(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert mirrored == pytest.approx(1 - got["roc_auc"])


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.4), ("n", 0, 0.1), ("n", 1, 0.1)], "model string, actual int, score double")
    got = {r["model"]: r["roc_auc"] for r in evaluation.roc_auc(df, ["model"]).collect()}
    assert got == {"m": None, "n": 0.5}


def test_metrics_are_zero_guarded(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "actual int, pred int")
    got = evaluation.metrics(df, digits=4).first()
    assert (got["precision"], got["recall"], got["f1"], got["mcc"], got["specificity"], got["accuracy"]) == (0, 0, 0, 0, 1, 0.5)


def test_best_checkpoint_prefers_the_later(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1), (4, float("nan"))], "epoch int, valid double")
    assert evaluation.best_checkpoint(df, "epoch", "valid").first()["epoch"] == 2


def test_a_fitted_batch_keeps_every_request(spark, data):
    """Fitted models, saved and loaded, answer in one plan; failures stay as rows with their reason."""
    from permeon.plans.catalog import batches

    out = batches.score_batch_fitted(spark, data).collect()
    asked = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 4 = 0").select("vec_id").collect()}
    assert sorted(r["vec_id"] for r in out) == sorted(asked)
    for r in out:
        found = r["vec_id"] % 5 == 0 or r["vec_id"] % 3 != 2
        described = found and r["vec_id"] % 17 != 5
        assert r["status"] == ("Success" if described else "Error")
        assert r["error"] == (None if described else "Descriptor calculation failed" if found else "Could not process molecule")
        assert (r["num_models"] == 3) if described else r["num_models"] is None and r["prediction"] is None
    good = [r for r in out if r["status"] == "Success"]
    assert all(0 <= r["confidence"] <= 100 and 0 <= r["uncertainty"] <= 50 and 50 <= r["agreement"] <= 100 for r in good)
    errors_first = [r["status"] == "Error" for r in out]
    assert errors_first == sorted(errors_first, reverse=True)


def test_rows_without_features_get_no_neighbours_vote(spark):
    from pyspark.ml.functions import array_to_vector

    from permeon.operators.knn import KNNClassifier
    from permeon.operators.tree_models import TreeEnsembleClassifier
    from permeon.operators.trees import forest_params

    rows = spark.range(40).select("id", array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") > 20).cast("double").alias("label"))
    asked = rows.select("id", F.when(F.col("id") < 3, F.col("features")).alias("features"))
    for est in (KNNClassifier(keyCol="id", k=3), TreeEnsembleClassifier.of(forest_params(5, 3), "id")):
        got = {r["id"]: r["prediction"] for r in est.fit(rows).transform(asked).collect()}
        assert len(got) == 40 and {k for k, v in got.items() if v is not None} == {0, 1, 2}
