"""Support vector machine with a radial kernel and probabilities.

The kernel is approximated by landmarks (Nyström): a row becomes its kernel values at
LANDMARKS rows of the training table, turned so that dot products of such rows are the
kernel's projection onto the landmarks' span. A linear machine learns on them. Its
margins become probabilities by Platt's sigmoid, fitted on margins of rows that
the machine behind them has not seen.

Landmarks are drawn by row key, so they do not hang on partitions. What reaches the
driver is bounded: the landmarks, their kernel matrix, and sums of the sigmoid's fit.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.functions.draws import draw
from permeon.operators.knn import feature_array

LANDMARKS = 256
PLATT_FOLDS = 3
#: Rows that a task of the linear machine takes at least.
TASK_ROWS = 2000
#: Rows whose kernel values a worker holds at a time.
BATCH_ROWS = 1024
#: Eigenvalues below this share of the largest are left out.
LEAST_SHARE = 1e-9


def kernel(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) between rows."""
    squares = (x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1)[None, :] - 2 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(squares, 0))


def nystroem(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Matrix that turns kernel values at the landmarks into features whose dot products are kernel values."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    some = values > LEAST_SHARE * values.max()
    return vectors[:, some] / np.sqrt(values[some])


class _KernelParams(HasFeaturesCol, HasLabelCol):
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0: one over columns times variance", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "training rows the kernel is measured at", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "penalty of the linear machine", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps of the linear machine", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "unique row id that draws hang on", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(gamma=0.0, landmarks=LANDMARKS, regParam=0.001, maxIter=30, keyCol="id", featuresCol="features", labelCol="label")


def _mapped(df: DataFrame, x: str, landmarks: np.ndarray, turn: np.ndarray, gamma: float, out: str) -> DataFrame:
    """Adds the kernel features of an array column without nulls as a vector."""
    shared = df.sparkSession.sparkContext.broadcast((landmarks, turn))

    @F.pandas_udf("array<double>")
    def features(values: pd.Series) -> pd.Series:
        at, matrix = shared.value
        out = []
        for i in range(0, len(values), BATCH_ROWS):
            out.extend(kernel(np.stack(values.iloc[i : i + BATCH_ROWS].to_numpy()).astype(float), at, gamma) @ matrix)
        return pd.Series(out, dtype=object)

    return df.withColumn(out, array_to_vector(features(x)))


def platt_sigmoid(margins: DataFrame, margin: str, label: str, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(a * margin + b)), by Newton's method; a round is one aggregation.

    Targets are drawn in a little from 0 and 1, as Platt does, so that separable margins have a fit.
    """
    sizes = margins.agg(F.count_if(F.col(label) == 1).alias("up"), F.count_if(F.col(label) != 1).alias("down")).first()
    up, down = sizes["up"], sizes["down"]
    goal = F.when(F.col(label) == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))

    def state(a: float, b: float):
        z = F.col(margin) * a + b
        p = 1 / (1 + F.exp(z))
        # ln(1 + e^z) without overflow on either side.
        loss = goal * F.greatest(z, F.lit(0.0)) + (1 - goal) * F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        w, e, f = p * (1 - p), goal - p, F.col(margin)
        return margins.agg(F.sum(loss).alias("loss"), *(F.sum(v).alias(n) for n, v in (("ga", e * f), ("gb", e), ("haa", w * f * f), ("hab", w * f), ("hbb", w)))).first()

    a, b = 0.0, math.log((down + 1) / (up + 1))
    now = state(a, b)
    for _ in range(rounds):
        if now["loss"] is None or max(abs(now["ga"]), abs(now["gb"])) < 1e-6 * (up + down):
            break
        haa, hab, hbb = now["haa"] + 1e-9, now["hab"], now["hbb"] + 1e-9
        det = haa * hbb - hab * hab
        da, db = -(hbb * now["ga"] - hab * now["gb"]) / det, -(haa * now["gb"] - hab * now["ga"]) / det
        step, better = 1.0, None
        while step > 1e-6:
            new = state(a + step * da, b + step * db)
            if new["loss"] < now["loss"]:
                better = new
                break
            step /= 2
        if better is None:
            break
        a, b, now = a + step * da, b + step * db, better
    return a, b


class KernelSVC(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Classes are 0 and 1."""

    @keyword_only
    def __init__(self, *, gamma=0.0, landmarks=LANDMARKS, regParam=0.001, maxIter=30, keyCol="id", featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _machine(self) -> LinearSVC:
        return LinearSVC(regParam=self.getOrDefault("regParam"), maxIter=self.getOrDefault("maxIter"), featuresCol="mapped", labelCol="label", standardization=False, tol=1e-4)

    def _fit(self, dataset: DataFrame) -> KernelSVCModel:
        key = F.col(self.getOrDefault("keyCol")).cast("string").alias("key")
        rows = dataset.select(key, feature_array(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label"))
        # What made the rows runs once, in tasks of its own: joined into few tasks below, its sorts would be held side by side.
        rows = rows.where("x IS NOT NULL AND label IS NOT NULL").persist()
        try:
            return self._fit_rows(rows)
        finally:
            rows.unpersist()

    def _fit_rows(self, rows: DataFrame) -> KernelSVCModel:
        n = rows.count()
        at = np.array([r["x"] for r in rows.orderBy(draw("landmark", "key"), "key").limit(self.getOrDefault("landmarks")).collect()], float)
        gamma = self.getOrDefault("gamma") or self._scale(rows, at.shape[1])
        turn = nystroem(at, gamma)
        # Every step is a job: a small table must not be spread over more tasks than its rows are worth.
        few = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), n // TASK_ROWS)))
        mapped = _mapped(few, "x", at, turn, gamma, "mapped").select("mapped", "label", (F.pmod(F.xxhash64("key"), F.lit(PLATT_FOLDS))).alias("fold")).persist()
        try:
            machine = self._machine().fit(mapped)
            unseen = None
            for f in range(PLATT_FOLDS):
                learn, held = mapped.where(F.col("fold") != f), mapped.where(F.col("fold") == f)
                part = _with_margin(held, self._machine().fit(learn))
                unseen = part if unseen is None else unseen.unionByName(part)
            unseen = unseen.coalesce(max(1, unseen.rdd.getNumPartitions() // PLATT_FOLDS)).persist()
            a, b = platt_sigmoid(unseen, "margin", "label")
            unseen.unpersist()
        finally:
            mapped.unpersist()
        model = KernelSVCModel()
        model.state = {"gamma": gamma, "landmarks": at, "weights": turn @ machine.coefficients.toArray(), "intercept": float(machine.intercept), "a": a, "b": b}
        return self._copyValues(model)

    @staticmethod
    def _scale(rows: DataFrame, width: int) -> float:
        """One over the number of columns times the variance of all values."""
        spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
        return 1.0 / (width * spread) if spread else 1.0


def _with_margin(df: DataFrame, machine) -> DataFrame:
    return machine.transform(df).select("label", vector_to_array("rawPrediction")[1].alias("margin"))


class KernelSVCModel(Model, _KernelParams, MLReadable, MLWritable):
    """Adds ``prediction`` (by the margin's sign) and ``probability``, in one narrow pass."""

    state: dict

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.state)

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            s = shared.value
            known = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            places = np.flatnonzero(known)
            for i in range(0, len(places), BATCH_ROWS):
                some = places[i : i + BATCH_ROWS]
                out[some] = kernel(np.stack(x.iloc[some].to_numpy()).astype(float), s["landmarks"], s["gamma"]) @ s["weights"] + s["intercept"]
            return pd.Series(out).where(known, None)

        scored = dataset.withColumn("__margin", margin(feature_array(dataset, self.getFeaturesCol())))
        p1 = 1 / (1 + F.exp(F.col("__margin") * self.state["a"] + self.state["b"]))
        return scored.withColumns({
            "prediction": (F.col("__margin") > 0).cast("double"),
            "probability": F.when(F.col("__margin").isNotNull(), array_to_vector(F.array(1 - p1, p1))),
        }).drop("__margin")

    def copy(self, extra=None) -> KernelSVCModel:
        other = super().copy(extra)
        other.state = self.state
        return other

    def write(self) -> MLWriter:
        return _KernelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KernelReader(cls)


class _KernelWriter(MLWriter):
    def __init__(self, model: KernelSVCModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.model.state.items()}
        self.sparkSession.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.text(f"{path}/state")


class _KernelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KernelSVCModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        plain = json.loads(self.sparkSession.read.text(f"{path}/state").first()[0])
        model.state = {k: np.array(v, float) if isinstance(v, list) else v for k, v in plain.items()}
        return model
