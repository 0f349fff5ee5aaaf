"""Scoring a batch of keys with error routing, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.operators.features import Scaler, apply_scaler
from permeon.operators.joins import candidates
from permeon.operators.projection import align_features, coerce_numeric
from permeon.operators.scoring import vote_on_row, with_answers

# Statuses and error texts of a batch result.
SUCCESS, ERROR = "Success", "Error"
UNRESOLVED = "Could not process molecule"
NO_FEATURES = "Descriptor calculation failed"

def resolve_inputs(
    batch: DataFrame,
    is_valid: Callable[[Column], Column],
    mode: str,
    lookup: DataFrame | None = None,
    lookup_key: str = "name",
    lookup_value: str = "smiles",
    lookup_order: Sequence[str] = (),
) -> DataFrame:
    """Add ``smiles``: the input itself if it is a valid key, else the looked-up one, else NULL.

    ``mode`` is 'smiles' (keys only), 'name' (names only) or 'mixed'.
    """
    direct = F.when(is_valid(F.col("input")), F.col("input")) if mode != "name" else F.lit(None).cast("string")
    out = batch.withColumn("smiles", direct)
    if mode == "smiles" or lookup is None:
        return out
    cand = candidates(lookup, lookup_key, lookup_value, list(lookup_order) or [lookup_value])
    found = F.col("__first.value")
    return (
        out.withColumn("__key", F.lower(F.trim("input")))
        .join(cand, "__key", "left")
        .withColumn("smiles", F.coalesce("smiles", F.when(is_valid(found), found)))
        .drop("__key", "__first", "__n")
    )


def score_batch(
    batch: DataFrame,
    key: str,
    resolve: Callable[[DataFrame], DataFrame],
    describe: Callable[[DataFrame], DataFrame],
    models: Mapping[str, object],
    expected: Sequence[str],
    scaler: Scaler | None = None,
    properties: Sequence[str] = (),
    vectors: bool = False,
) -> DataFrame:
    """One result row per input row: a prediction, or an error with its reason.

    ``batch`` has (key, input, name). ``resolve`` adds ``smiles``; ``describe``
    adds features, a ``failed`` flag and any ``properties``. ``models`` are
    fitted Spark ML models (with ``vectors``) or column expressions.

    Failures are a column all the way and every model answers on the same row,
    so the batch is one narrow pass: bad rows neither stop the good ones nor
    need a plan of their own.
    """
    rows = describe(resolve(batch))
    keep = [key, "input", "name", "smiles", "failed", *properties]
    numeric = coerce_numeric(rows, [c for c in expected if c in rows.columns])
    ready = apply_scaler(align_features(numeric, expected, keep=keep), scaler)
    if vectors:
        ready = ready.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`") for c in expected])))
    answered = with_answers(ready, models)
    error = F.when(F.col("smiles").isNull(), UNRESOLVED).when(F.col("failed"), NO_FEATURES)
    good = F.col("error").isNull()
    return answered.withColumn("error", error).select(
        key,
        "input",
        "name",
        "smiles",
        F.when(good, SUCCESS).otherwise(ERROR).alias("status"),
        "error",
        *[F.when(good, e).alias(n) for n, e in vote_on_row("answers").items()],
        *[F.when(good, F.col(p)).alias(p) for p in properties],
    )


def order_for_display(results: DataFrame, key: str) -> DataFrame:
    """Errors first, then successes, each in input order."""
    return results.orderBy(F.when(F.col("status") == ERROR, 0).otherwise(1), key)
