"""Joins. Sides are never forced to broadcast: their sizes are known at run time, to AQE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.operators.ordering import ranked

# Fixed value: note left on a row whose name has several candidates.
AMBIGUOUS_NOTE = "More than one CID available for "


def join_features(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of labels and features on the key ('left' or 'inner')."""
    return left.join(right, key, how)


def lookup_first(
    left: DataFrame, right: DataFrame, key: str, value: str, order: Sequence[str], right_key: str | None = None
) -> DataFrame:
    """Value of the first right row per key, or NULL; never multiplies left rows.

    The right side is reduced per key before the shuffle, so repeats of a hot
    key cost nothing downstream.
    """
    first = right.groupBy(F.col(right_key or key).alias(key)).agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__hit")
    )
    return left.join(first, key, "left").withColumn(value, F.col("__hit.v")).drop("__hit")


def new_rows(new: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """Rows whose key the target lacks; a missing key matches a missing key."""
    known = target.select(F.col(target_key or key).alias("__known")).distinct()
    return new.join(known, new[key].eqNullSafe(known["__known"]), "left_anti")


def zip_join(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[str] | str,
    right_order: Sequence[str] | str,
    lo: int = 0,
    hi: int | None = None,
    right_cols: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Attach rows [lo, hi) of ``right`` to ``left`` by position.

    Both orders are stated; Spark tables have none of their own. 'inner' ends
    with the shorter side, 'left' pads the missing positions with NULL.
    """
    a = ranked(left, left_order, name="row_pos")
    b = ranked(right, right_order, name="__pos").filter(F.col("__pos") >= lo)
    if hi is not None:
        b = b.filter(F.col("__pos") < hi)
    b = b.select((F.col("__pos") - lo).alias("row_pos"), *(right_cols or right.columns))
    return a.join(b, "row_pos", how)


def hconcat(a: DataFrame, b: DataFrame, a_order: Sequence[str] | str, b_order: Sequence[str] | str) -> DataFrame:
    """Two tables side by side by position, padding the shorter one."""
    return zip_join(a, b, a_order, b_order, how="full")


def candidates(lookup: DataFrame, key: str, value: str, order: Sequence[str], synonyms: str | None = None) -> DataFrame:
    """Per key: the first candidate, its synonyms, and how many candidates there are."""
    payload = [F.col(value).alias("value")]
    if synonyms:
        payload.append(F.col(synonyms).alias("synonyms"))
    return lookup.groupBy(F.lower(F.col(key)).alias("__key")).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__n")
    )


def enrich_identifier(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    lookup_key: str,
    value: str,
    order: Sequence[str],
    synonyms: str | None = None,
    target: str = "cid",
    comments: str = "comments",
) -> DataFrame:
    """Fill a missing identifier from a lookup table, by lower-cased name.

    The first candidate is taken. With two or more candidates, none of whose
    first one's synonyms is the name itself, a note is left in ``comments``.
    An identifier already present is kept.
    """
    cand = candidates(lookup, lookup_key, value, order, synonyms)
    name = F.lower(F.col(key))
    out = df.withColumn("__key", name).join(cand, "__key", "left")
    if target not in df.columns:
        out = out.withColumn(target, F.lit(None).cast(lookup.schema[value].dataType))
    if comments not in df.columns:
        out = out.withColumn(comments, F.lit(None).cast("string"))
    open_slot = F.col(target).isNull()
    confirmed: Column = F.lit(False)
    if synonyms:
        known = F.transform(F.col("__first.synonyms"), lambda s: F.lower(s))
        confirmed = F.coalesce(F.array_contains(known, F.col("__key")), F.lit(False))
    ambiguous = open_slot & (F.col("__n") >= 2) & ~confirmed
    note = F.concat(F.lit(AMBIGUOUS_NOTE), F.col("__key"))
    return (
        out.withColumn(comments, F.when(ambiguous, note).otherwise(F.col(comments)))
        .withColumn(target, F.coalesce(F.col(target), F.col("__first.value")))
        .drop("__key", "__first", "__n")
    )
