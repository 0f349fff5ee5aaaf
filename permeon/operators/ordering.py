"""Positions and running totals over a global order, without a one-task window.

``Window.orderBy`` with no partition sends every row to one task, and a
partition key that holds a third of the table does nearly the same. Here the order (of the
whole table, or of a hot group) is first cut into buckets by bounds that are rows of
the whole sort key, each value in its own type: any number of keys of any type that
Spark can order, ties included. A small table of bucket totals then turns bucket-local
running sums into global ones. The bounds come from a sample and only decide balance;
the result never depends on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permeon.functions.draws import DRAW_BITS
from permeon.session import bucket_count

MIN_HOT_ROWS = 100_000
#: Sampled rows for each bucket that is cut.
ROWS_PER_CUT = 32


@dataclass(frozen=True)
class Cuts:
    """Where an order is cut: distinct rows of its keys, in that order.

    A ``step`` instead of bounds stands for equal widths of a draw from zero up.
    """

    bounds: tuple[tuple, ...] = ()
    step: int = 0


def _directions(order: Sequence[str], ascending: Sequence[bool] | bool) -> list[bool]:
    return [ascending] * len(order) if isinstance(ascending, bool) else list(ascending)


def sort_columns(order: Sequence[str], ascending: Sequence[bool] | bool = True) -> list[Column]:
    """The order as Spark sort columns; missing keys come last in both directions."""
    ups = _directions(order, ascending)
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(order, ups)]


def quantile_cuts(
    df: DataFrame, order: Sequence[str], ascending: Sequence[bool] | bool = True, pieces: int | None = None
) -> Cuts:
    """About evenly spread bounds of the order, from a sample of ROWS_PER_CUT rows for each piece."""
    pieces = pieces or bucket_count(df.sparkSession)
    keys = df.select(*order)
    rows = keys.count()
    if rows < 2:
        return Cuts()
    share = min(1.0, ROWS_PER_CUT * pieces / rows)
    sample = keys if share == 1.0 else keys.sample(share, seed=17)
    found = [tuple(r) for r in sample.orderBy(*sort_columns(order, ascending)).collect()]
    every = max(1, len(found) // pieces)
    return Cuts(tuple(dict.fromkeys(found[every::every])))


def uniform_cuts(df: DataFrame, pieces: int | None = None) -> Cuts:
    """Bounds for a draw: known to be uniform, so no pass over the data is needed."""
    pieces = pieces or bucket_count(df.sparkSession)
    return Cuts(step=2**DRAW_BITS // pieces)


def _bound_upto_row(bound: Sequence[Column], row: Sequence[Column], ascending: Sequence[bool]) -> Column:
    """Whether a bound is at or before a row in the order."""
    upto = F.lit(True)
    for b, x, up in reversed(list(zip(bound, row, ascending))):
        before = F.when(b.isNull(), False).when(x.isNull(), True).otherwise((b < x) if up else (b > x))
        upto = before | (b.eqNullSafe(x) & upto)
    return upto


def with_order_bucket(df: DataFrame, order: Sequence[str], ascending: Sequence[bool], cuts: Cuts, name: str) -> DataFrame:
    """Add an integer that grows with the order; rows of one bucket are neighbours.

    With bounds it is the number of bounds at or before the row, found by bisection.
    """
    if cuts.step:
        place = F.call_function("div", F.col(order[0]), F.lit(cuts.step))
        last = 2**DRAW_BITS // cuts.step + 1
        place = place if ascending[0] else F.lit(last) - place
        return df.withColumn(name, F.coalesce(place, F.lit(last + 1)))
    if not cuts.bounds:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    arrays = [
        F.array(*[F.lit(b[i]) for b in cuts.bounds]).cast(f"array<{df.schema[c].dataType.simpleString()}>")
        for i, c in enumerate(order)
    ]
    row = [F.col(c) for c in order]
    steps = [1 << k for k in reversed(range(len(cuts.bounds).bit_length()))]

    def advance(at: Column, step: Column) -> Column:
        inside = at + step <= len(cuts.bounds)
        bound = [F.get(a, at + step - 1) for a in arrays]
        return F.when(inside & _bound_upto_row(bound, row, ascending), at + step).otherwise(at)

    place = F.aggregate(F.array(*[F.lit(s).cast("bigint") for s in steps]), F.lit(0).cast("bigint"), advance)
    return df.withColumn(name, F.coalesce(place, F.lit(0).cast("bigint")))


def hot_groups(df: DataFrame, by: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Keys of the groups too large for one task.

    The default limit is a quarter of an even task's share, so that at most four
    keys per shuffle partition can be over it.
    """
    if hot_rows is None:
        hot_rows = max(MIN_HOT_ROWS, df.count() // (4 * bucket_count(df.sparkSession)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.filter(F.col("__n") > hot_rows).select(*by)


def _hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int | None) -> DataFrame | None:
    """Hot groups as a table to join with: fixed and broadcast if few, else as it is; None if there are none."""
    hot, few = hot_groups(df, by, hot_rows), 4 * bucket_count(df.sparkSession)
    rows = hot.limit(few + 1).collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema)) if len(rows) <= few else hot


def running_totals(
    df: DataFrame,
    order: Sequence[str] | str,
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    ascending: Sequence[bool] | bool = True,
    cuts: Cuts | None = None,
    totals: Mapping[str, str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` in the given order, per ``by`` group.

    ``totals`` maps a measure to the name of an extra column with its group
    total. ``order`` must be a total order within a group for reproducible
    results. Missing sort keys come last in both directions.

    Without ``cuts``, groups are looked at first and only those over
    ``hot_rows`` are cut into buckets; with ``cuts`` every group is.
    """
    order = [order] if isinstance(order, str) else list(order)
    ascending = _directions(order, ascending)
    totals = dict(totals or {})

    # A struct compares NULL members as equal and is never NULL itself, so joins
    # on it stay plain equi-joins on the window's own partitioning.
    grouped = df.withColumn("__group", F.struct(*[F.col(c) for c in by]) if by else F.lit(0))
    if not by or cuts is not None:
        cuts = quantile_cuts(df, order, ascending) if cuts is None else cuts
        coded = with_order_bucket(grouped, order, ascending, cuts, "__bucket")
        cut_rows = coded
    else:
        hot = _hot_keys(df, by, hot_rows)
        if hot is not None:
            flagged = grouped.join(hot.select(F.struct(*by).alias("__group"), F.lit(True).alias("__hot")), "__group", "left")
            cuts = quantile_cuts(flagged.filter("__hot"), order, ascending)
            coded = with_order_bucket(flagged, order, ascending, cuts, "__bucket")
            coded = coded.withColumn("__bucket", F.when(F.col("__hot"), F.col("__bucket")).otherwise(F.lit(-1)))
            cut_rows = coded.filter("__hot")
        else:
            coded, cut_rows = grouped.withColumn("__bucket", F.lit(-1)), None

    sort = sort_columns(order, ascending)
    names = list(measures)
    bucket = Window.partitionBy("__group", "__bucket")
    upto = bucket.orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    here = coded.select(
        "*",
        *[F.sum(measures[m]).over(upto).alias(f"__{m}") for m in names],
        *[F.sum(measures[m]).over(bucket).alias(f"__all_{m}") for m in totals],
    )
    kept = [F.col(f"`{c}`") for c in df.columns]
    if cut_rows is None:
        return here.select(
            *kept, *[F.col(f"__{m}").alias(m) for m in names], *[F.col(f"__all_{m}").alias(t) for m, t in totals.items()]
        )

    # At most one row per bucket here, however large the group.
    sums = cut_rows.groupBy("__group", "__bucket").agg(*[F.sum(measures[m]).alias(f"__{m}") for m in names])
    before = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__group")
    offsets = sums.select(
        "__group",
        "__bucket",
        *[F.sum(f"__{m}").over(before).alias(f"__before_{m}") for m in names],
        *[F.sum(f"__{m}").over(whole).alias(f"__total_{m}") for m in totals],
    )
    joined = here.join(offsets, ["__group", "__bucket"], "left")
    return joined.select(
        *kept,
        *[(F.col(f"__{m}") + F.coalesce(f"__before_{m}", F.lit(0))).alias(m) for m in names],
        *[F.coalesce(f"__total_{m}", f"__all_{m}").alias(t) for m, t in totals.items()],
    )


def ranked(
    df: DataFrame,
    order: Sequence[str] | str,
    by: Sequence[str] = (),
    name: str = "row_pos",
    start: int = 0,
    ascending: Sequence[bool] | bool = True,
    cuts: Cuts | None = None,
    total: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Dense position of each row in its group; ``total`` adds the group size."""
    out = running_totals(
        df, order, {name: F.lit(1)}, by, ascending, cuts, {name: total} if total else None, hot_rows
    )
    return out if start == 1 else out.withColumn(name, F.col(name) - F.lit(1 - start))


def ranked_by_draw(
    df: DataFrame, draw_col: str, *ties: str, by: Sequence[str] = (), name: str = "row_pos", total: str | None = None
) -> DataFrame:
    """:func:`ranked` on a draw column, whose even spread spares the bounds pass."""
    order = [draw_col, *ties]
    return ranked(df, order, by, name, cuts=uniform_cuts(df), total=total)
