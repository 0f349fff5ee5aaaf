"""Classifier evaluation, exact at any size.

Rows need ``actual`` and ``pred`` (0/1), and ``score`` for the ranking metrics;
``by`` evaluates many models in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.functions.cleaning import safe_ratio
from permeon.operators.ordering import quantile_cuts, running_totals


def _cells() -> list[Column]:
    hit = lambda a, p: F.count_if((F.col("actual") == a) & (F.col("pred") == p))
    return [hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp")]


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP."""
    return df.groupBy(*by).agg(*_cells()) if by else df.agg(*_cells())


def with_metrics(cm: DataFrame, digits: int | None = None) -> DataFrame:
    """Accuracy to MCC from a confusion matrix, every ratio 0 where its base is empty."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    values = {
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "specificity": safe_ratio(tn, tn + fp),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": safe_ratio(tp * tn - fp * fn, root),
    }
    return cm.select("*", *[(F.round(e, digits) if digits is not None else e).alias(n) for n, e in values.items()])


def metrics(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    return with_metrics(confusion(df, by), digits)


def ranking_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (tied scores averaged) and step-wise average precision.

    Rows are merged by score first, then one running total over the distinct
    scores feeds both. A single class gives NULL.
    """
    rows = df.filter(F.col("score").isNotNull())
    cuts = quantile_cuts(rows, ["score"])
    by_score = rows.groupBy(*by, "score").agg(
        F.count_if(F.col("actual") == 1).alias("pos"), F.count_if(F.col("actual") == 0).alias("neg")
    )
    run = running_totals(
        by_score,
        "score",
        {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")},
        by,
        cuts=cuts,
        totals={"pos_upto": "n_pos", "neg_upto": "n_neg"},
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    ranked_below = pos * (F.col("neg_upto") - neg / 2)
    pos_above = F.col("n_pos") - F.col("pos_upto") + pos
    neg_above = F.col("n_neg") - F.col("neg_upto") + neg
    step = safe_ratio(pos * pos_above, pos_above + neg_above)
    sums = [
        F.sum(ranked_below).alias("__below"),
        F.sum(step).alias("__steps"),
        F.max("n_pos").cast("double").alias("__p"),
        F.max("n_neg").cast("double").alias("__n"),
    ]
    totals = run.groupBy(*by).agg(*sums) if by else run.agg(*sums)
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return totals.select(
        *by,
        F.when(both, F.try_divide(F.col("__below"), F.col("__p") * F.col("__n"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("__steps"), F.col("__p"))).alias("average_precision"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "average_precision")


def class_hits(df: DataFrame) -> DataFrame:
    """Of each actual class, how many rows each model got right, and the percentage."""
    return df.groupBy("actual", "model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("pred") == F.col("actual")).alias("hits"),
        (F.avg(F.when(F.col("pred") == F.col("actual"), 1.0).otherwise(0.0)) * 100).alias("hit_rate"),
    )


def leaderboard(df: DataFrame, model: str = "model", sort_by: str = "f1") -> DataFrame:
    """All metrics per model, best first."""
    board = metrics(df, [model]).join(ranking_metrics(df, [model]), model, "left")
    order = ["accuracy", "f1", "roc_auc", "average_precision", "precision", "recall", "specificity", "mcc"]
    return board.select(model, *order).orderBy(F.col(sort_by).desc(), model)


def cv_summary(folds: DataFrame, model: str, score: str) -> DataFrame:
    """Mean and population deviation of the fold scores per model."""
    return folds.groupBy(model).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("n_folds")
    )


def best_checkpoint(history: DataFrame, epoch: str, valid: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the best validation score, the later epoch among equals."""
    rest = [c for c in history.columns if c not in by]
    scored = history.filter(F.col(valid).isNotNull() & ~F.isnan(F.col(valid).cast("double")))
    best = F.max_by(F.struct(*rest), F.struct(valid, epoch)).alias("__best")
    picked = scored.groupBy(*by).agg(best) if by else scored.agg(best)
    return picked.select(*by, "__best.*")
