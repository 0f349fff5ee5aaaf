"""Ensembles over one long score table ``(id, model, pred, p1)``.

``pred`` is the model's 0/1 answer and ``p1`` its probability of the positive
class, NULL for a model that gives none. Every flavour is one aggregation per
id; the model count is small and fixed, so groups stay tiny however many ids
there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.labels import NEGATIVE, POSITIVE, decode_label, decode_vote

# Neutral confidence, reliable head, votes needed, preferred model, property rules.
NEUTRAL = 50.0
RELIABLE = 0.7
VOTES_NEEDED = 3
PRIMARY_MODEL = "XGB"
PROPERTY_RULES = {
    "mw": (None, 450.0, False),
    "logp": (1.0, 3.0, True),
    "hbd": (None, 3.0, False),
    "hba": (None, 7.0, False),
    "tpsa": (None, 90.0, False),
}

_label = lambda positive: F.when(positive, POSITIVE).otherwise(NEGATIVE)


def _folded(share: Column) -> Column:
    """Agreement in percent, counted for whichever side has the majority."""
    pct = share * 100
    return F.when(pct < 50, F.lit(100.0) - pct).otherwise(pct)


def ensemble_mean(scores: DataFrame, key: str) -> DataFrame:
    """Probability mean: positive above 0.5; uncertainty is the largest class deviation.

    A model without a probability takes no part, its vote included.
    """
    scores = scores.filter(F.col("p1").isNotNull())
    p1 = F.avg("p1")
    # Rounded for the comparison: a mean of exactly one half must not tip over by summation order.
    return scores.groupBy(key).agg(
        _label(F.round(p1, 12) > 0.5).alias("prediction"),
        (F.greatest(p1, 1 - p1) * 100).alias("confidence"),
        (F.stddev_pop("p1") * 100).alias("uncertainty"),
        _folded(F.avg("pred")).alias("agreement"),
        F.count(F.lit(1)).alias("num_models"),
    )


def ensemble_vote_batch(scores: DataFrame, key: str) -> DataFrame:
    """Vote, positive from half up; confidence is the mean of P(positive) over all models."""
    conf = F.coalesce(F.avg("p1") * 100, F.lit(NEUTRAL))
    return scores.groupBy(key).agg(
        _label(F.avg("pred") >= 0.5).alias("prediction"),
        conf.alias("confidence"),
        F.when(F.count("p1") > 1, F.stddev_pop("p1") * 100).otherwise(F.abs(NEUTRAL - conf)).alias("uncertainty"),
        _folded(F.avg("pred")).alias("agreement"),
        F.count(F.lit(1)).alias("num_models"),
    )


def ensemble_vote_agree(scores: DataFrame, key: str) -> DataFrame:
    """The same vote; confidence is the mean winning probability of the agreeing models."""
    own = F.greatest(F.col("p1"), 1 - F.col("p1")) * 100
    own = F.when(F.col("p1").isNotNull(), own)
    up, down = F.avg(F.when(F.col("pred") == 1, own)), F.avg(F.when(F.col("pred") == 0, own))
    wins = F.avg("pred") >= 0.5
    return scores.groupBy(key).agg(
        _label(wins).alias("prediction"),
        F.coalesce(F.when(wins, up).otherwise(down), F.lit(NEUTRAL)).alias("confidence"),
        F.count(F.lit(1)).alias("num_models"),
    )


def majority(scores: DataFrame, key: str, need: int = VOTES_NEEDED) -> DataFrame:
    """Positive from ``need`` votes up."""
    votes = F.sum("pred")
    return scores.groupBy(key).agg(votes.alias("votes"), _label(votes >= need).alias("prediction"))


def majority_wide(df: DataFrame, models: Sequence[str], need: int = VOTES_NEEDED, out: str = "final") -> DataFrame:
    """The same over one 0/1 column per model."""
    votes = sum((F.coalesce(F.col(m), F.lit(0)) for m in models), F.lit(0))
    return df.withColumn(out, F.when(votes >= need, 1).otherwise(0))


def _count_vote() -> Column:
    return _label(F.count_if(F.col("pred") == 1) >= F.count_if(F.col("pred") == 0))


def ensemble_count(scores: DataFrame, key: str) -> DataFrame:
    """Count vote: positive if at least as many ones as zeros; plain mean confidence, 0 if none."""
    return scores.groupBy(key).agg(
        _count_vote().alias("prediction"),
        F.coalesce(F.avg("p1") * 100, F.lit(0.0)).alias("confidence"),
    )


def primary_score(scores: DataFrame, key: str, prefer: str = PRIMARY_MODEL, order: Sequence[str] = ("model",)) -> DataFrame:
    """The preferred model's answer if there is one, else the first model's."""
    rank = F.struct((F.col("model") != prefer).alias("second"), *order)
    picked = scores.groupBy(key).agg(F.min_by(F.struct("model", "pred", "p1"), rank).alias("s"))
    p1 = F.col("s.p1")
    return picked.select(
        key,
        F.col("s.model").alias("model"),
        decode_label("s.pred").alias("prediction"),
        (F.when(F.col("s.pred") == 1, p1).otherwise(1 - p1) * 100).alias("confidence"),
    )


def predictions_wide(
    scores: DataFrame, key: str, models: Sequence[str], actual: DataFrame | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """One prediction and one ``<model>_proba`` column per model, and ``extra`` aggregates.

    The model list is given, so no extra pass has to find the pivot values.
    """
    cells = []
    for m in models:
        mine = F.col("model") == m
        cells += [F.max(F.when(mine, F.col("pred"))).alias(m), F.max(F.when(mine, F.col("p1"))).alias(f"{m}_proba")]
    wide = scores.groupBy(key).agg(*cells, *extra)
    return wide.join(actual, key) if actual is not None else wide


def export_row(scores: DataFrame, key: str, models: Sequence[str], info: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Flat export: each model's label and confidence, the count vote, and the ``info`` columns.

    A missing answer exports as the negative label; its confidence stays empty.
    """
    wide = predictions_wide(scores, key, models, extra=[_count_vote().alias("prediction")])
    cols = []
    for m in models:
        p1 = F.col(f"{m}_proba")
        own = F.when(p1.isNotNull(), F.greatest(p1, 1 - p1) * 100)
        cols += [decode_label(m).alias(f"{m}_prediction"), own.alias(f"{m}_confidence")]
    wide = wide.select(key, *cols, F.col("prediction").alias("ensemble_prediction"))
    out = info.join(wide, key)
    return out.withColumn("timestamp", timestamp) if timestamp is not None else out


def model_table(scores: DataFrame, key: str) -> DataFrame:
    """Per-model label and displayed confidence; a missing answer reads ``N/A``."""
    return scores.select(
        key,
        "model",
        decode_vote("pred").alias("prediction"),
        F.when(F.col("p1").isNotNull(), F.format_string("%.1f", F.bround(F.greatest(F.col("p1"), 1 - F.col("p1")) * 100, 1)))
        .otherwise("N/A")
        .alias("confidence"),
    )


def softmax_head(df: DataFrame, logits: Column, threshold: float = RELIABLE) -> DataFrame:
    """Logits to probabilities, arg-max class, its probability, and whether it is reliable."""
    return (
        df.withColumn("__logits", logits)
        .withColumn("__top", F.array_max("__logits"))
        .withColumn("__exp", F.transform("__logits", lambda x: F.exp(x - F.col("__top"))))
        .withColumn("__sum", F.aggregate("__exp", F.lit(0.0), lambda a, x: a + x))
        .withColumn("probabilities", F.transform("__exp", lambda x: x / F.col("__sum")))
        .withColumn("confidence", F.array_max("probabilities"))
        .withColumn("prediction", (F.array_position("__logits", F.col("__top")) - 1).cast("int"))
        .withColumn("permeable", F.col("prediction") == 1)
        .withColumn("reliable", F.col("confidence") >= threshold)
        .drop("__logits", "__top", "__exp", "__sum")
    )


def _answer(name: str, pred: Column, p1: Column) -> Column:
    return F.struct(F.lit(name).alias("model"), pred.cast("int").alias("pred"), p1.cast("double").alias("p1"))


def with_answers(df: DataFrame, models: Mapping[str, object], out: str = "answers") -> DataFrame:
    """Add one array of (model, pred, p1) per row, without a shuffle or a second scan.

    A model is a fitted Spark ML model over the frame's ``features``, or a
    function that returns its (pred, p1) column expressions.
    """
    cells = []
    for name, model in models.items():
        if callable(model):
            cells.append(_answer(name, *model()))
            continue
        scored = model.transform(df)
        p1 = vector_to_array("probability")[1] if "probability" in scored.columns else F.lit(None)
        df = scored.withColumn(f"__{name}", _answer(name, F.col("prediction"), p1))
        df = df.drop("prediction", "rawPrediction", "probability")
        cells.append(F.col(f"__{name}"))
    return df.withColumn(out, F.array(*cells)).drop(*[f"__{n}" for n in models])


def vote_on_row(answers: Column | str) -> dict[str, Column]:
    """:func:`ensemble_vote_batch` for the answer array of one row."""
    answers = F.col(answers) if isinstance(answers, str) else answers
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    share = total(F.transform(answers, lambda a: a["pred"].cast("double"))) / F.size(answers)
    known = F.transform(F.filter(answers, lambda a: a["p1"].isNotNull()), lambda a: a["p1"] * 100)
    n = F.size(known)
    mean = F.try_divide(total(known), n)
    spread = F.sqrt(total(F.transform(known, lambda p: (p - mean) * (p - mean))) / n)
    confidence = F.coalesce(mean, F.lit(NEUTRAL))
    return {
        "prediction": _label(share >= 0.5),
        "confidence": confidence,
        "uncertainty": F.when(n > 1, spread).otherwise(F.abs(NEUTRAL - confidence)),
        "agreement": _folded(share),
        "num_models": F.size(answers).cast("bigint"),
    }


def long_scores(df: DataFrame, key: str, models: Mapping[str, tuple[Column, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Expression models ``name -> (pred, p1)`` to the long score table, in one projection."""
    return df.select(key, *keep, F.inline(F.array(*[_answer(m, *cols) for m, cols in models.items()])))


def score_models(df: DataFrame, key: str, models: Mapping[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Long score table of fitted Spark ML models, all in one pass over the feature frame."""
    return with_answers(df, models, "__answers").select(key, *keep, F.inline("__answers"))


def labelled_confidence(scores: DataFrame) -> DataFrame:
    """Each model's label text and 100 times the probability of the class it chose."""
    p1 = F.col("p1")
    return scores.withColumn("prediction", decode_label("pred")).withColumn(
        "confidence", F.when(F.col("pred") == 1, p1).otherwise(1 - p1) * 100
    )


def batch_predict(
    df: DataFrame, key: str, features: str, fn: Callable[[np.ndarray], np.ndarray], size: int = 64
) -> DataFrame:
    """Score an array column in chunks of ``size`` rows with a matrix function."""
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                matrix = np.stack(part[features].to_numpy()).astype("float64")
                yield pd.DataFrame({key: part[key].to_numpy(), "score": np.asarray(fn(matrix), "float64").ravel()})

    return df.select(key, features).mapInPandas(run, schema)


def rule_screen(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None, bool]] | None = None) -> DataFrame:
    """A pass flag per property rule ``(low, high, high included)``, and how many passed."""
    rules = rules or PROPERTY_RULES
    flags = {}
    for col, (lo, hi, closed) in rules.items():
        ok = F.lit(True)
        if lo is not None:
            ok &= F.col(col) >= lo
        if hi is not None:
            ok &= (F.col(col) <= hi) if closed else (F.col(col) < hi)
        flags[f"{col}_ok"] = F.coalesce(ok, F.lit(False))
    out = df.select("*", *[e.alias(n) for n, e in flags.items()])
    passed = sum((F.when(F.col(n), 1).otherwise(0) for n in flags), F.lit(0))
    return out.withColumn("rules_passed", passed)
