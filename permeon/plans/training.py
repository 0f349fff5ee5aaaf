"""Split, scale, balance, tune and evaluate, in an order that does not leak test rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.operators.evaluation import leaderboard
from permeon.operators.features import Scaler, apply_array_scaler, fit_array_scaler
from permeon.operators.models import as_vectors
from permeon.operators.sampling import SEED, balanced, stratified_split
from permeon.operators.scoring import score_models


@dataclass
class TrainingRun:
    models: dict[str, Model]
    scaler: Scaler
    train: DataFrame
    test: DataFrame
    board: DataFrame


def prepare(
    df: DataFrame, key: str, features: str, label: str, test: float = 0.2, balance: bool = True, leaky: bool = False, seed: int = SEED
) -> tuple[DataFrame, DataFrame, Scaler]:
    """(train, test, scaler), both sides scaled and the training side balanced.

    The scaler and the synthetic rows come from training rows only. ``leaky``
    scales and balances before splitting, the order older published numbers
    were made with.
    """
    cols = [key, label, features]
    if leaky:
        scaler = fit_array_scaler(df, features)
        even = balanced(apply_array_scaler(df.select(*cols), features, scaler), key, features, label, seed=seed)
        # Synthetic rows have no id of their own; their values serve as one.
        tagged = even.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json(F.struct(features)), 256)))
        parts = stratified_split(tagged, "__key", label, test, seed).drop("__key", "synthetic")
        return parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test"), scaler
    parts = stratified_split(df.select(*cols), key, label, test, seed)
    train, held = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")
    scaler = fit_array_scaler(train, features)
    train, held = (apply_array_scaler(p, features, scaler) for p in (train, held))
    return (balanced(train, key, features, label, seed=seed) if balance else train), held, scaler


def train_and_evaluate(
    df: DataFrame, key: str, features: str, label: str, estimators: Mapping[str, Estimator], **options
) -> TrainingRun:
    """Fit every estimator on the prepared training side and rank them on the held-out rows."""
    train, held, scaler = prepare(df, key, features, label, **options)
    fit_rows = as_vectors(train, features, label).persist()
    try:
        models = {n: e.fit(fit_rows) for n, e in estimators.items()}
    finally:
        fit_rows.unpersist()
    scores = score_models(as_vectors(held, features, label, [key]), key, models, keep=["label"])
    rows = scores.select("model", F.col("label").cast("int").alias("actual"), "pred", F.col("p1").alias("score"))
    return TrainingRun(models, scaler, train, held, leaderboard(rows))


def feature_names(df: DataFrame, features: str, prefix: str = "f") -> Sequence[str]:
    """Names for the positions of an array feature column."""
    return [f"{prefix}{i}" for i in range(len(df.select(features).first()[0]))]
