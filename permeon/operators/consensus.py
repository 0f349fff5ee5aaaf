"""Resolving replicate measurements and labels to one value per key.

Replicates are first counted per (key, value) on the map side, so what a key
brings to its task is its distinct values, not its rows. Measurements are
carried as integers of hundredths: sums, rounding and ties are then exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.functions.cleaning import finite_or_null
from permeon.functions.labels import LOGBB_CUTOFF, NEGATIVE, POSITIVE, binarise
from permeon.functions.rounding import decimals_in_hundredths, halves_even_div, hundredths

# Replicate span limit (hundredths), closeness 5 % = 1/20, failure mark.
SPAN_LIMIT = 100
CLOSENESS = 20
DROPPED = "dropped"


def _in_units(h: Column, decimals: Column) -> Column:
    """Hundredths rounded half-even to the key's own number of decimals."""
    return F.when(decimals == 2, h).otherwise(halves_even_div(h, F.lit(10)))


def numeric_consensus(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key: consensus ``value``, its quality ``group``, population ``std``, replicates ``n``.

    Keys whose replicates span more than 1 are removed. The groups: A single
    value, B all within 5 % of the mean, C mean of two, D unique mode, and
    dropped_E/F/G for tied modes (three tied, two of several tied, two only).
    """
    keys = list(keys)
    number = df.withColumn("__v", finite_or_null(value)).filter(F.col("__v").isNotNull())
    measured = number.select(*keys, hundredths("__v").alias("__h"))
    counts = measured.groupBy(*keys, "__h").agg(F.count(F.lit(1)).alias("__n"))
    spans = counts.groupBy(*keys).agg(
        F.min("__h").alias("__lo"),
        F.max("__h").alias("__hi"),
        F.min(decimals_in_hundredths(F.col("__h"))).alias("__d"),
        F.sum("__n").alias("__rows"),
    )
    # Looking at the row counts as well makes both sides of the join below one plan, so the counts are shuffled once.
    kept = spans.filter((F.col("__hi") - F.col("__lo") <= SPAN_LIMIT) & (F.col("__rows") > 0)).drop("__rows")

    # From here on a key has at most 101 distinct values.
    rounded = (
        counts.join(kept, keys)
        .withColumn("__u", _in_units(F.col("__h"), F.col("__d")))
        .withColumn("__base", _in_units(F.col("__lo"), F.col("__d")))
        .groupBy(*keys, "__d", "__base", "__u")
        .agg(F.sum("__n").alias("__n"))
    )
    off = F.col("__u") - F.col("__base")
    stats = rounded.groupBy(*keys, "__d").agg(
        F.sum("__n").alias("n"),
        F.sum(F.col("__u") * F.col("__n")).alias("__sum"),
        F.sum((off * F.col("__n")).cast("double")).alias("__off1"),
        F.sum((off * off * F.col("__n")).cast("double")).alias("__off2"),
        F.min("__u").alias("__min"),
        F.max("__u").alias("__max"),
        # Most frequent first, the larger value first among equals.
        F.sort_array(F.collect_list(F.struct("__n", "__u")), asc=False).alias("__modes"),
    )

    n, mean = F.col("n"), F.col("__mean")
    count_of = lambda i: F.get("__modes", F.lit(i))["__n"]
    value_of = lambda i: F.get("__modes", F.lit(i))["__u"].cast("double")
    kinds = F.size("__modes")
    close = F.greatest(F.col("__max") - mean, mean - F.col("__min")) * CLOSENESS <= F.abs(mean)
    group = (
        F.when(n == 1, "A")
        .when(close, "B")
        .when(n == 2, "C")
        .when(count_of(0) > count_of(1), "D")
        .when(kinds == 2, "dropped_G")
        .when(count_of(1) == count_of(2), "dropped_E")
        .otherwise("dropped_F")
    )
    units = (
        F.when(F.col("group") == "D", value_of(0))
        .when(F.col("group") == "dropped_E", (value_of(0) + value_of(1) + value_of(2)) / 3)
        .when(F.col("group") == "dropped_F", (value_of(0) + value_of(1)) / 2)
        .otherwise(mean.cast("double"))
    )
    scale = F.when(F.col("__d") == 2, F.lit(100.0)).otherwise(F.lit(10.0))
    variance = F.col("__off2") / n - (F.col("__off1") / n) * (F.col("__off1") / n)
    return (
        stats.withColumn("__mean", halves_even_div(F.col("__sum"), n))
        .withColumn("group", group)
        .select(
            *keys,
            (units / scale).alias("value"),
            "group",
            F.when(n == 1, F.lit(0.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))) / scale).alias("std"),
            "n",
        )
    )


def label_consensus(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    measured: str | None = None,
    threshold: str | None = None,
    cutoff: float = LOGBB_CUTOFF,
    positive: str = POSITIVE,
    negative: str = NEGATIVE,
    value_name: str | None = None,
) -> DataFrame:
    """One row per key: consensus ``label``, its quality ``group``, and the measured value as ``value_name``.

    A measured value decides by the cutoff (A). Otherwise labels count: where
    the source threshold equals the cutoff they must all agree (B, else
    dropped_group1); without it agreement is C, a strict plurality D, and a tie
    dropped_group2. A dropped key has an empty label.
    """
    keys = list(keys)
    value = F.col(measured).cast("double") if measured else F.lit(None).cast("double")
    limit = F.col(threshold).cast("double") if threshold else F.lit(None).cast("double")
    votes = df.groupBy(*keys, F.col(label).alias("__label")).agg(
        F.min(value).alias("__value"),
        F.min(limit).alias("__limit"),
        F.count_if(value.isNull() & F.col(label).isNotNull()).alias("__n"),
    )
    voted = F.col("__n") > 0
    # The winner is unique exactly if it is both the last and the first label among the most frequent.
    tally = votes.groupBy(*keys).agg(
        F.min("__value").alias("__value"),
        F.min("__limit").alias("__limit"),
        F.count_if(voted).alias("__kinds"),
        F.max(F.when(voted, F.struct("__n", "__label")))["__label"].alias("__last"),
        F.min(F.when(voted, F.struct((-F.col("__n")).alias("m"), "__label")))["__label"].alias("__first"),
    )
    has_value = F.col("__value").isNotNull()
    agree = F.col("__kinds") == 1
    strict = F.coalesce(F.col("__limit") == cutoff, F.lit(False))
    group = (
        F.when(has_value, "A")
        .when(strict & agree, "B")
        .when(strict, "dropped_group1")
        .when(agree, "C")
        .when(F.col("__last") == F.col("__first"), "D")
        .otherwise("dropped_group2")
    )
    decided = (
        F.when(has_value, binarise(F.col("__value"), cutoff, positive, negative))
        .when(F.col("group").startswith(DROPPED), F.lit(""))
        .otherwise(F.col("__last"))
    )
    return (
        tally.filter(has_value | (F.col("__kinds") > 0))
        .withColumn("group", group)
        .select(*keys, *([F.col("__value").alias(value_name)] if value_name else []), decided.alias("label"), "group")
    )


def drop_groups(df: DataFrame, group: str = "group") -> DataFrame:
    """Remove keys whose replicates could not be resolved."""
    return df.filter(~F.col(group).contains(DROPPED))


def _usable_name(c: Column, drop_single: bool) -> Column:
    ok = c.isNotNull() & (c != "nan") & (c != "") & ~c.rlike(r"^\d+$")
    if drop_single:
        ok &= F.length(c) != 1
    return F.when(ok, F.ltrim(F.lower(c)))


def pick_name(
    df: DataFrame,
    keys: Sequence[str],
    preferred: str,
    fallback: str,
    alternative: str | None = None,
    alternative_order: Sequence[str] = (),
    drop_single: bool = False,
    out: str = "picked_name",
) -> DataFrame:
    """One lower-cased name per key.

    Names from the preferred column come before the fallback's, alphabetical
    among themselves; with neither, the first usable alternative. Missing texts,
    plain numbers and (``drop_single``) one-letter names do not count.
    """
    first, second = (_usable_name(F.col(c), drop_single) for c in (preferred, fallback))
    aggs = [F.coalesce(F.min(first), F.min(second)).alias(out)]
    if alternative:
        alt = _usable_name(F.col(alternative), drop_single)
        order = F.struct(*alternative_order) if alternative_order else alt
        aggs.append(F.min_by(alt, F.when(alt.isNotNull(), order)).alias("__alt"))
    picked = df.groupBy(*keys).agg(*aggs)
    if alternative:
        picked = picked.withColumn(out, F.coalesce(out, "__alt", F.lit(""))).drop("__alt")
    return picked


def whole_number(c: Column) -> Column:
    """``int(float(x))`` of a text, NULL where it is no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 9e18), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))


def pick_id(df: DataFrame, keys: Sequence[str], col: str, out: str = "picked_id") -> DataFrame:
    """The smallest valid integer id per key, NULL if there is none."""
    return df.groupBy(*keys).agg(F.min(whole_number(F.col(col).cast("string"))).alias(out))


def pick_text(df: DataFrame, keys: Sequence[str], col: str, out: str = "picked_key") -> DataFrame:
    """The alphabetically first usable text per key."""
    text = F.col(col)
    return df.groupBy(*keys).agg(F.min(F.when((text != "nan") & (text != ""), text)).alias(out))
