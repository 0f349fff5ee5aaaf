"""Spark ML: fits, tuning, out-of-fold scores, importances. Checked by properties, not by SQL."""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import functions as F

from permeon.operators import models, sampling, scoring
from permeon.operators.evaluation import metrics
from permeon.operators.features import apply_array_scaler, fingerprint_vector, fit_array_scaler
from permeon.operators.kernel import KernelSVC
from permeon.operators.knn import KNN_GRID, KNNClassifier, search_neighbors
from permeon.operators.tree_models import TREE_GRIDS, TreeEnsembleClassifier, accuracy, f1, score_table, search_trees
from permeon.operators.trees import boosted_params, extra_params, forest_params, leafwise_params
from permeon.plans.catalog.registry import Tables, draw_sql, query
from permeon.plans.training import feature_names, train_and_evaluate
from permeon.session import scratch_dir


def _labelled(spark, d):
    y = F.when(F.col("label") >= 5, 1).otherwise(0)
    return Tables(spark, d).embeddings.select("vec_id", "embedding", y.alias("y"))


def _frames(spark, d):
    parts = sampling.stratified_split(_labelled(spark, d), "vec_id", "y")
    train, test = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")
    scaler = fit_array_scaler(train, "embedding")
    a, b = (models.as_vectors(apply_array_scaler(p, "embedding", scaler), "embedding", "y", ["vec_id"]) for p in (train, test))
    return a, b


def _folds(spark, d, k):
    rows = sampling.stratified_folds(_labelled(spark, d), "vec_id", "y", k)
    return models.as_vectors(rows, "embedding", "y", ["vec_id", "fold"])


def _fit_scores(spark, d, name, estimator):
    train, test = _frames(spark, d)
    return scoring.score_models(test, "vec_id", {name: estimator.fit(train)}, keep=["label"])


@query("logistic_regression")
def logistic_regression(spark, d):
    train, test = _frames(spark, d)
    est = models.logreg(train.count(), C=1.0)
    return scoring.score_models(test, "vec_id", {"LR": est.fit(train)}, keep=["label"])


@query("random_forest")
def random_forest(spark, d):
    return _fit_scores(spark, d, "RF", models.forest(100, 8))


@query("extra_trees")
def extra_trees(spark, d):
    return _fit_scores(spark, d, "ET", TreeEnsembleClassifier.of(extra_params(100, 8), "vec_id"))


@query("boosted_trees")
def boosted_trees(spark, d):
    return _fit_scores(spark, d, "LGBM", TreeEnsembleClassifier.of(leafwise_params(100, 31), "vec_id"))


@query("support_vectors")
def support_vectors(spark, d):
    return _fit_scores(spark, d, "SVM", KernelSVC(keyCol="vec_id"))


@query("perceptron")
def perceptron(spark, d):
    width = len(feature_names(_labelled(spark, d), "embedding"))
    return _fit_scores(spark, d, "MLP", models.mlp(width))


#: Folds of the searches.
SEARCH_FOLDS = 5
_TUNING = "model string, params string, mean_score double, std_score double"


def _product(grid: dict) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def _searched(spark, settings: dict[str, list[dict]], rows, metric):
    """Score table of tree families and KNN over their settings, all folds of a family in one run."""
    shape = {"RF": forest_params, "ET": extra_params, "XGB": boosted_params, "LGBM": leafwise_params}
    trees = [(name, s) for name, own in settings.items() if name in shape for s in own]
    names, counts = [(n, json.dumps(s, sort_keys=True)) for n, s in trees], search_trees(rows, [shape[n](**s) for n, s in trees], SEARCH_FOLDS, key="vec_id")
    if "KNN" in settings:
        names += [("KNN", json.dumps(s, sort_keys=True)) for s in settings["KNN"]]
        counts += search_neighbors(rows, settings["KNN"], SEARCH_FOLDS, "vec_id")
    table = score_table(names, counts, metric)
    return [(n, params, mean, std) for (n, params), mean, std in table]


@query("grid_search")
def grid_search(spark, d):
    rows = models.in_few_tasks(_folds(spark, d, SEARCH_FOLDS), "vec_id").persist()
    n = rows.count() * (SEARCH_FOLDS - 1) // SEARCH_FOLDS
    linear = models.tune(models.logreg(n), {"regParam": [1.0 / (c * n) for c in models.GRIDS["LR"]["C"]]}, rows, folds=SEARCH_FOLDS)
    out = [("LR", *r) for r in models.tuning_table(linear)]
    families = {name: _product(grid) for name, grid in TREE_GRIDS.items()} | {"KNN": _product(KNN_GRID)}
    out += _searched(spark, families, rows, accuracy)
    rows.unpersist()
    return spark.createDataFrame(out, _TUNING)


#: Trials and ranges of the original searches. Minkowski distance is Euclidean there.
SEARCHES = {
    "RF": (50, {
        "trees": lambda r: 50 * int(r.integers(2, 21)),
        "max_depth": lambda r: int(r.integers(5, 51)),
        "min_split": lambda r: int(r.integers(2, 21)),
        "min_leaf": lambda r: int(r.integers(1, 21)),
        "features": lambda r: str(r.choice(["sqrt", "log2"])),
        "criterion": lambda r: str(r.choice(["gini", "entropy"])),
    }),
    "KNN": (50, {
        "k": lambda r: int(r.integers(1, 31)),
        "weights": lambda r: str(r.choice(["uniform", "distance"])),
        "metric": lambda r: str(r.choice(["euclidean", "manhattan", "minkowski"])),
    }),
    "XGB": (100, {
        "trees": lambda r: int(r.integers(100, 1001)),
        "max_depth": lambda r: int(r.integers(3, 21)),
        "step": lambda r: float(r.uniform(0.01, 0.3)),
        "subsample": lambda r: float(r.uniform(0.6, 1.0)),
        "columns": lambda r: float(r.uniform(0.6, 1.0)),
        "gamma": lambda r: float(r.uniform(0.0, 5.0)),
    }),
}


def drawn_settings(family: str, seed: int = sampling.SEED) -> list[dict]:
    """The trials of a family: seeded draws from its ranges."""
    trials, space = SEARCHES[family]
    rng = np.random.default_rng(seed)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(trials)]


@query("sampled_search")
def sampled_search(spark, d):
    rows = _folds(spark, d, SEARCH_FOLDS).persist()
    out = _searched(spark, {name: drawn_settings(name) for name in SEARCHES}, rows, f1)
    rows.unpersist()
    return spark.createDataFrame(out, _TUNING)


@query("model_zoo")
def model_zoo(spark, d):
    train, test = _frames(spark, d)
    width = len(feature_names(_labelled(spark, d), "embedding"))
    zoo = models.default_zoo(train.count(), width)
    return models.model_zoo(zoo, train, test, "vec_id")


@query("save_load_bundle")
def save_load_bundle(spark, d):
    train, test = _frames(spark, d)
    fitted = {"KNN": KNNClassifier(keyCol="vec_id").fit(train), "GBT": models.boosted(20, max_depth=3).fit(train), "ET": models.extra_trees(50, 8).fit(train)}
    path = scratch_dir(spark, "bundle")
    names = feature_names(_labelled(spark, d), "embedding")
    models.save_bundle(spark, models.ModelBundle(fitted, list(names)), path)
    return scoring.labelled_confidence(scoring.score_models(test, "vec_id", models.load_bundle(spark, path).models))


@query("out_of_fold")
def out_of_fold(spark, d):
    rows = _folds(spark, d, models.OOF_FOLDS)
    return models.oof_predict(models.logreg(rows.count()), rows, "vec_id")


@query("single_model_scores")
def single_model_scores(spark, d):
    train, test = _frames(spark, d)
    fitted = {"RF": models.forest().fit(train), "GBT": models.boosted(20, max_depth=3).fit(train)}
    return scoring.labelled_confidence(scoring.score_models(test, "vec_id", fitted, keep=["label"]))


@query(
    "chunked_inference",
    """SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(1, len(embedding) + 1),
      lambda i: embedding[i]::DOUBLE * ((i - 1) % 5 - 2))))), 6) AS score FROM embeddings""",
)
def chunked_inference(spark, d):
    def head(x: np.ndarray) -> np.ndarray:
        weights = np.arange(x.shape[1]) % 5 - 2
        return 1 / (1 + np.exp(-(x @ weights)))

    out = scoring.batch_predict(Tables(spark, d).embeddings, "vec_id", "embedding", head, size=64)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query("built_in_importance")
def built_in_importance(spark, d):
    train, _ = _frames(spark, d)
    names = feature_names(_labelled(spark, d), "embedding")
    return models.importances(spark, models.forest().fit(train), names, 20)


@query("permutation_importance")
def permutation_importance(spark, d):
    train, _ = _frames(spark, d)
    names = feature_names(_labelled(spark, d), "embedding")
    fitted = models.logreg(train.count()).fit(train)
    return models.permutation_importance(fitted, train, "vec_id", names, share=0.3, repeats=5)


@query("fingerprint_model")
def fingerprint_model(spark, d):
    t = Tables(spark, d)
    rows = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    parts = sampling.stratified_split(fingerprint_vector(rows, "text").drop("text"), "doc_id", "label").persist()
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    fitted = models.logreg(train.count(), C=0.1, max_iter=100).fit(train)
    scored = scoring.score_models(test, "doc_id", {"LR": fitted}, keep=["label"])
    return metrics(scored.select(F.col("label").cast("int").alias("actual"), "pred"))


@query("train_and_evaluate")
def train_evaluate(spark, d):
    y = F.when(F.col("label") >= 7, 1).otherwise(0)
    rows = Tables(spark, d).embeddings.select("vec_id", "embedding", y.alias("y"))
    zoo = {"LR": models.logreg(rows.count(), C=0.1), "RF": models.forest()}
    return train_and_evaluate(rows, "vec_id", "embedding", "y", zoo).board


_FOLDED = f"""f AS (SELECT vec_id, (label >= 5)::INT AS y, embedding::DOUBLE[] AS x,
    (row_number() OVER (PARTITION BY label >= 5 ORDER BY {draw_sql(42, 'vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings)"""


def _neighbours_sql(metric: str, k: int) -> str:
    return f"""n AS (SELECT a.vec_id, a.fold, a.y AS label, b.y, {metric} AS dist,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY {metric}, b.vec_id) AS rank
      FROM f a JOIN f b ON a.fold <> b.fold QUALIFY rank <= {k})"""


@query(
    "knn_out_of_fold",
    f"""WITH {_FOLDED}, {_neighbours_sql('list_distance(a.x, b.x)', 5)}
    SELECT vec_id, fold, label::DOUBLE AS label, (sum(y) * 2 > 5)::INT AS pred, sum(y) / 5 AS p1 FROM n GROUP BY ALL""",
)
def knn_out_of_fold(spark, d):
    scored = models.oof_predict(KNNClassifier(keyCol="vec_id"), _folds(spark, d, 5), "vec_id")
    return scored.withColumn("fold", F.col("fold").cast("bigint"))


_MANHATTAN = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))"


def _grid_votes_sql() -> str:
    """One vote per row and setting of KNN_GRID."""
    parts = []
    for s in _product(KNN_GRID):
        k, rank, dist = s["k"], {"euclidean": "re", "manhattan": "rm"}[s["metric"]], s["metric"]
        if s["weights"] == "distance":
            side = f"round(coalesce(sum(CASE WHEN y = {{c}} THEN CASE WHEN nearest = 0 THEN ({dist} = 0)::INT ELSE 1 / {dist} END END), 0), 12)"
            vote = f"({side.format(c=1)} > {side.format(c=0)})::INT"
        else:
            vote = f"(sum(y) * 2 > {k})::INT"
        parts.append(f"""SELECT {k} AS k, '{s["weights"]}' AS weights, '{dist}' AS metric, vec_id, fold, label, {vote} AS pred
          FROM (SELECT *, min({dist}) OVER (PARTITION BY vec_id) AS nearest FROM r WHERE {rank} <= {k}) GROUP BY vec_id, fold, label""")
    return " UNION ALL ".join(parts)


@query(
    "knn_grid_search",
    f"""WITH {_FOLDED}, m AS (SELECT a.vec_id, a.fold, a.y AS label, b.y, b.vec_id AS other, list_distance(a.x, b.x) AS euclidean,
        {_MANHATTAN} AS manhattan FROM f a JOIN f b ON a.fold <> b.fold),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY euclidean, other) AS re,
        row_number() OVER (PARTITION BY vec_id ORDER BY manhattan, other) AS rm FROM m QUALIFY least(re, rm) <= {max(KNN_GRID["k"])}),
    v AS ({_grid_votes_sql()}),
    a AS (SELECT k, weights, metric, fold, avg((pred = label)::INT) AS acc FROM v GROUP BY ALL)
    SELECT k::BIGINT AS k, weights, metric, round(avg(acc), 9) AS mean_score FROM a GROUP BY ALL""",
)
def knn_grid_search(spark, d):
    settings = _product(KNN_GRID)
    counts = search_neighbors(_folds(spark, d, 5), settings, 5, "vec_id")
    rows = [(s["k"], s["weights"], s["metric"], round(float(np.mean([accuracy(*c) for c in per_fold])), 9)) for s, per_fold in zip(settings, counts, strict=True)]
    return spark.createDataFrame(rows, "k bigint, weights string, metric string, mean_score double")
