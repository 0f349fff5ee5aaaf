"""Reproducible samples, splits, folds and minority oversampling.

Row order is a draw from the row's own id, so a split does not depend on how
the table is partitioned, and its sizes are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.functions.draws import draw, unit_draw
from permeon.operators.neighbors import nearest_neighbors
from permeon.operators.ordering import ranked_by_draw

SEED = 42
SMOTE_NEIGHBORS = 5


def _drawn(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("__draw", draw(seed, key))


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows, or all if there are fewer, in the order of their draws; the same ones on every run."""
    placed = ranked_by_draw(_drawn(df, key, seed), "__draw", key, name="__pos").filter(F.col("__pos") < n)
    return placed.orderBy("__pos").drop("__draw", "__pos")


def _held_out(total: Column, share: float) -> Column:
    return F.round(total * F.lit(share)).cast("bigint")


def split(
    df: DataFrame, key: str, shares: Sequence[tuple[str, float]], label: str | None = None, seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Name each row's part. Parts after the first take round(share * n) rows, per label if given.

    ``shares`` lists the parts, e.g. ``[("train", 0.8), ("test", 0.2)]``; the
    first one gets what the others leave.
    """
    by = [label] if label else []
    placed = ranked_by_draw(_drawn(df, key, seed), "__draw", key, by=by, name="__pos", total="__total")
    part = None
    taken: Column = F.lit(0)
    for name, share in shares[1:]:
        taken = taken + _held_out(F.col("__total"), share)
        inside = F.col("__pos") < taken
        part = F.when(inside, name) if part is None else part.when(inside, name)
    return placed.withColumn(out, part.otherwise(shares[0][0])).drop("__draw", "__pos", "__total")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Train/test with the class ratio kept."""
    return split(df, key, [("train", 1 - test), ("test", test)], label, seed)


def plain_split(df: DataFrame, key: str, test: float = 0.2, seed: int = SEED) -> DataFrame:
    return split(df, key, [("train", 1 - test), ("test", test)], None, seed)


def three_way_split(df: DataFrame, key: str, holdout: float = 0.2, seed: int = SEED) -> DataFrame:
    """Train, and the holdout halved into validation and test."""
    return split(df, key, [("train", 1 - holdout), ("valid", holdout / 2), ("test", holdout / 2)], None, seed)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1, each class dealt round-robin in draw order."""
    placed = ranked_by_draw(_drawn(df, key, seed), "__draw", key, by=[label], name="__pos")
    return placed.withColumn(out, (F.col("__pos") % k).cast("int")).drop("__draw", "__pos")


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class; the number of classes is the task's, not the data's."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def smote(
    df: DataFrame, key: str, features: str, label: str, k: int = SMOTE_NEIGHBORS, seed: int = SEED
) -> DataFrame:
    """Synthetic minority rows until every class has the size of the largest.

    The i-th synthetic row takes a drawn minority row, one of its k nearest
    same-class neighbours, and a point on the segment between them. Returns
    ``(label, i, base, neighbor, u, features)``; the input rows are not repeated.
    """
    sizes = class_sizes(df, label)
    biggest = max(sizes.values())
    out = None
    for cls, n in sorted(sizes.items()):
        if n == biggest:
            continue
        if n < 2:
            raise ValueError(f"class {cls!r} has {n} row: no neighbour to interpolate with")
        rows = df.filter(F.col(label) == cls).select(key, F.col(features).cast("array<double>").alias(features))
        kk = min(k, n - 1)
        near = nearest_neighbors(rows, rows, key, features, k=kk, exclude_self=True).select(
            F.col("query_id").alias("base"), F.col("rank").alias("pick"), F.col("neighbor_id").alias("neighbor")
        )
        drawn = rows.select(F.col(key).alias("base"), draw(seed, F.lit("place"), key).alias("__draw"))
        places = ranked_by_draw(drawn, "__draw", "base", name="place").drop("__draw")
        wanted = df.sparkSession.range(biggest - n).select(
            F.col("id").alias("i"),
            (draw(seed, F.lit(f"{cls}-base"), "id") % n).alias("place"),
            (draw(seed, F.lit(f"{cls}-pick"), "id") % kk + 1).alias("pick"),
            unit_draw(seed, F.lit(f"{cls}-u"), "id").alias("u"),
        )
        a = rows.select(F.col(key).alias("base"), F.col(features).alias("__a"))
        b = rows.select(F.col(key).alias("neighbor"), F.col(features).alias("__b"))
        made = (
            wanted.join(places, "place")
            .join(near, ["base", "pick"])
            .join(a, "base")
            .join(b, "neighbor")
            .select(
                F.lit(cls).cast(df.schema[label].dataType).alias(label),
                "i",
                "base",
                "neighbor",
                "u",
                F.zip_with("__a", "__b", lambda x, y: x + F.col("u") * (y - x)).alias(features),
            )
        )
        out = made if out is None else out.unionByName(made)
    if out is None:
        empty = df.select(label, F.lit(0).cast("bigint").alias("i"), F.col(key).alias("base"), F.col(key).alias("neighbor"))
        return empty.select("*", F.lit(0.0).alias("u"), F.lit(None).cast("array<double>").alias(features)).limit(0)
    return out


def balanced(df: DataFrame, key: str, features: str, label: str, k: int = SMOTE_NEIGHBORS, seed: int = SEED) -> DataFrame:
    """Input rows plus the synthetic ones; synthetic rows have no key."""
    real = df.select(key, label, F.col(features).cast("array<double>").alias(features), F.lit(False).alias("synthetic"))
    made = smote(df, key, features, label, k, seed).select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), label, features, F.lit(True).alias("synthetic")
    )
    return real.unionByName(made)
