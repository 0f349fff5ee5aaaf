"""Model factories, tuning, out-of-fold prediction, persistence and importances on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.draws import draw
from permeon.operators.evaluation import leaderboard
from permeon.operators.features import Scaler
from permeon.operators.ordering import ranked_by_draw
from permeon.operators.sampling import SEED, stratified_split
from permeon.operators.scoring import score_models

_COLS = {"featuresCol": "features", "labelCol": "label"}

# Search grids of the original training flow.
GRIDS: dict[str, dict[str, list]] = {
    "LR": {"C": [0.1, 1.0, 10.0]},
    "RF": {"numTrees": [100, 200], "maxDepth": [8, 16], "minInstancesPerNode": [2, 5]},
    "ET": {"numTrees": [100, 200], "maxDepth": [8, 16], "minInstancesPerNode": [2, 5]},
    "GBT": {"maxIter": [50, 100], "maxDepth": [3, 5], "stepSize": [0.05, 0.1], "subsamplingRate": [0.8, 1.0]},
}
OOF_FOLDS = 5
TASKS_A_CORE = 2
PERMUTATION_REPEATS = 5
PERMUTATION_SHARE = 0.3


def as_vectors(df: DataFrame, features: str, label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The frame Spark ML wants: ``features`` vector and double ``label``."""
    cols = [*keep, array_to_vector(F.col(features).cast("array<double>")).alias("features")]
    if label:
        cols.append(F.col(label).cast("double").alias("label"))
    return df.select(*cols)


def logreg(n_rows: int, C: float = 1.0, max_iter: int = 1000, **kw) -> LogisticRegression:
    """L2 logistic regression; inverse strength C on a summed loss is 1/(C*n) on Spark's mean loss."""
    return LogisticRegression(regParam=1.0 / (C * n_rows), elasticNetParam=0.0, maxIter=max_iter, standardization=False, **_COLS, **kw)


def forest(num_trees: int = 100, max_depth: int = 8, seed: int = SEED, **kw) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed, **_COLS, **kw)


def extra_trees(num_trees: int = 100, max_depth: int = 16, seed: int = SEED, **kw) -> RandomForestClassifier:
    """Forest on the whole sample with few candidate bins.

    Spark has no randomly drawn thresholds; this shares the no-bootstrap part
    only and is not claimed equal.
    """
    return RandomForestClassifier(
        numTrees=num_trees, maxDepth=max_depth, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed, **_COLS, **kw
    )


def boosted(max_iter: int = 100, step: float = 0.1, max_depth: int = 5, subsample: float = 1.0, seed: int = SEED, **kw) -> GBTClassifier:
    """Gradient boosting, grown by depth rather than by leaf."""
    return GBTClassifier(maxIter=max_iter, stepSize=step, maxDepth=max_depth, subsamplingRate=subsample, seed=seed, **_COLS, **kw)


def svm(max_iter: int = 100, reg: float = 0.01, **kw) -> LinearSVC:
    """Linear support vector machine; put :func:`fourier_features` in front for a radial kernel."""
    return LinearSVC(maxIter=max_iter, regParam=reg, **_COLS, **kw)


def mlp(n_features: int, hidden: Sequence[int] = (64, 32), max_iter: int = 100, seed: int = SEED, **kw) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed, **_COLS, **kw)


def fourier_features(df: DataFrame, features: str, n_features: int, out_dim: int, gamma: float, seed: int = SEED) -> DataFrame:
    """Random projection whose dot product approximates the radial kernel exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, (2 * gamma) ** 0.5, (n_features, out_dim))
    offsets = rng.uniform(0.0, 2 * np.pi, out_dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()).astype("float64") if len(pdf) else np.empty((0, n_features))
            z = (2 / out_dim) ** 0.5 * np.cos(x @ weights + offsets)
            yield pdf.assign(**{features: list(z)})

    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == features else f for f in df.schema.fields]
    )
    return df.mapInPandas(run, schema)


def in_few_tasks(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at most TASKS_A_CORE partitions a core: every step of a fit is a job, whose tasks must not be many and tiny."""
    most = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most, key) if df.rdd.getNumPartitions() > most else df


def param_grid(est: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    return builder.build()


def _validated(est: Estimator, maps: Sequence[dict], train: DataFrame, fold: str, folds: int, metric: str, parallelism: int):
    scorer = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=list(maps), evaluator=scorer, numFolds=folds, foldCol=fold, parallelism=parallelism
    )
    return cv.fit(train)


def tune(
    est: Estimator,
    grid: Mapping[str, Sequence],
    train: DataFrame,
    fold: str = "fold",
    folds: int = 5,
    metric: str = "accuracy",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Every grid combination over given stratified folds; the best is refitted on all rows."""
    return _validated(est, param_grid(est, grid), train, fold, folds, metric, parallelism)


def sampled_search(
    est: Estimator,
    space: Mapping[str, Callable[[np.random.Generator], object]],
    n: int,
    train: DataFrame,
    fold: str = "fold",
    folds: int = 5,
    metric: str = "f1",
    seed: int = SEED,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """``n`` seeded random parameter settings instead of a grid."""
    rng = np.random.default_rng(seed)
    maps = [{est.getParam(p): sample(rng) for p, sample in space.items()} for _ in range(n)]
    return _validated(est, maps, train, fold, folds, metric, parallelism)


def tuning_table(model: CrossValidatorModel) -> list[tuple[str, float, float]]:
    """(parameters, mean score, deviation over folds) per setting, best first."""
    rows = [
        (json.dumps({p.name: v for p, v in m.items()}, sort_keys=True, default=str), float(a), float(s))
        for m, a, s in zip(model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics)
    ]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def default_zoo(n_rows: int, n_features: int) -> dict[str, Estimator]:
    """Untuned model of each family."""
    return {
        "LR": logreg(n_rows),
        "RF": forest(),
        "ET": extra_trees(100, 8),
        "GBT": boosted(50, max_depth=3),
        "SVM": svm(),
        "MLP": mlp(n_features),
    }


def model_zoo(zoo: Mapping[str, Estimator], train: DataFrame, test: DataFrame, key: str, threads: int = 3) -> DataFrame:
    """Leaderboard of many default models on one cached split, by accuracy."""
    train = in_few_tasks(train, key).persist()
    try:
        with ThreadPoolExecutor(threads) as pool:
            fitted = dict(zip(zoo, pool.map(lambda e: e.fit(train), zoo.values())))
    finally:
        train.unpersist()
    scores = score_models(test, key, fitted, keep=["label"])
    rows = scores.select("model", F.col("label").cast("int").alias("actual"), "pred", F.col("p1").alias("score"))
    return leaderboard(rows, sort_by="accuracy")


def oof_predict(est: Estimator, df: DataFrame, key: str, fold: str = "fold", folds: int = OOF_FOLDS) -> DataFrame:
    """Each row scored by the model that did not see it: ``(key, fold, label, pred, p1)``."""
    parts = None
    for i in range(folds):
        model = est.fit(df.filter(F.col(fold) != i))
        one = score_models(df.filter(F.col(fold) == i), key, {str(i): model}, keep=[fold, "label"])
        parts = one if parts is None else parts.unionByName(one)
    return parts.drop("model")


@dataclass
class ModelBundle:
    """Named fitted models with the scaler and feature list they expect."""

    models: dict[str, Model]
    features: list[str]
    scaler: Scaler | None = None
    errors: dict[str, str] = field(default_factory=dict)


def save_bundle(spark, bundle: ModelBundle, path: str) -> None:
    """One Spark ML folder per model, and one line of JSON for the rest."""
    for name, model in bundle.models.items():
        pipe = model if isinstance(model, PipelineModel) else PipelineModel([model])
        pipe.write().overwrite().save(f"{path}/models/{name}")
    meta = {"models": sorted(bundle.models), "features": bundle.features}
    if bundle.scaler:
        s = bundle.scaler
        meta["scaler"] = {"names": list(s.names), "means": list(s.means), "stds": list(s.stds)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark, path: str) -> ModelBundle:
    """Load what loads; a model that does not is listed in ``errors``."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    models, errors = {}, {}
    for name in meta["models"]:
        try:
            models[name] = PipelineModel.load(f"{path}/models/{name}")
        except Exception as e:  # a damaged model must not hide the others
            errors[name] = str(e).splitlines()[0]
    s = meta.get("scaler")
    scaler = Scaler(tuple(s["names"]), tuple(s["means"]), tuple(s["stds"])) if s else None
    return ModelBundle(models, meta["features"], scaler, errors)


def _last_stage(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importances(spark, model: Model, names: Sequence[str], k: int = 20) -> DataFrame:
    """Tree gains or absolute coefficients, the ``k`` largest."""
    stage = _last_stage(model)
    if hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    else:
        values = np.abs(stage.coefficients.toArray())
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(
    model: Model,
    df: DataFrame,
    key: str,
    names: Sequence[str],
    label: str = "label",
    features: str = "features",
    share: float = PERMUTATION_SHARE,
    repeats: int = PERMUTATION_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Mean accuracy lost when one feature is shuffled, on a stratified sample.

    A shuffle is a join: the row at position i takes the value of the row whose
    draw for this (feature, repeat) has rank i. All shuffles run in one pass.
    """
    part = stratified_split(df, key, label, test=share, seed=seed).filter(F.col("split") == "test")
    rows = part.select(key, label, vector_to_array(features).alias("x"), draw(seed, F.lit("place"), key).alias("d"))
    sample = ranked_by_draw(rows, "d", key, name="pos").drop("d").persist()
    try:
        shuffles = F.array(
            *[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f in range(len(names)) for r in range(repeats)]
        )
        long = sample.select(key, "x", F.inline(shuffles)).select(
            "f", "r", F.element_at("x", F.col("f") + 1).alias("v"), draw(seed, key, "f", "r").alias("d"), key
        )
        drawn = ranked_by_draw(long, "d", key, by=["f", "r"], name="pos").select("f", "r", "pos", "v")
        # The drawn values of a row come together first, so its vector travels once, not once per shuffle.
        gathered = drawn.groupBy("pos").agg(F.collect_list(F.struct("f", "r", "v")).alias("drawn"))
        shuffled = sample.join(gathered, "pos").select(label, "x", F.inline("drawn")).select(
            "f", "r", label, F.transform("x", lambda x, i: F.when(i == F.col("f"), F.col("v")).otherwise(x)).alias("x")
        )
        hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
        scored = model.transform(shuffled.select("f", "r", label, array_to_vector("x").alias(features)))
        base = model.transform(sample.select(label, array_to_vector("x").alias(features))).agg(hit.alias("a")).first()["a"]
        drops = scored.groupBy("f", "r").agg((F.lit(base) - hit).alias("drop"))
        out = drops.groupBy("f").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std")).collect()
    finally:
        sample.unpersist()
    rows = sorted(((names[r["f"]], r["importance"], r["std"]) for r in out), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double")

