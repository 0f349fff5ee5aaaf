"""From raw measurement records of many sources to one labelled row per structure key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.functions.text import HEAVY_ELEMENTS
from permeon.operators.aggregates import split_by_presence
from permeon.operators.consensus import drop_groups, label_consensus, numeric_consensus
from permeon.operators.features import canonicalize, element_screen, keep_largest_part
from permeon.operators.filters import drop_null, filter_range

# Measurement floor, and the decision threshold stated by the sources that gave one (R2 an interval).
VALUE_FLOOR = -9.0
SOURCE_THRESHOLDS = {
    "R1": "-1", "R2": "(-2,-1)", "R7": "-1", "R8": "0", "R13": "-1", "R16": "-1", "R18": "0.1", "R19": "-1", "R25": "0", "R28": "-1",
}


def source_threshold(reference: str) -> Column:
    """What the record's source states, as text; null for sources that state nothing."""
    stated = F.create_map(*[F.lit(x) for pair in SOURCE_THRESHOLDS.items() for x in pair])
    return F.try_element_at(stated, F.col(reference))


def clean_keys(records: DataFrame, raw_key: str, banned: Sequence[str] = (), sep: str | None = None) -> DataFrame:
    """Drop keyless records, keep the largest part, screen elements, normalise the key."""
    out = drop_null(records, [raw_key])
    if sep:
        out = keep_largest_part(out, raw_key, sep)
    if banned:
        out = element_screen(out, raw_key, banned)
    return canonicalize(out, raw_key, "key")


def curate(records: DataFrame, key: str, value: str, label: str, threshold: str | None = None) -> DataFrame:
    """``(key, value, label, group)``: measured keys by numeric consensus, the rest by vote.

    A key with a usable measurement is labelled by it; its votes are not needed.
    Unresolved keys are dropped.
    """
    measured, voted = split_by_presence(records, value)
    numbers = drop_groups(numeric_consensus(filter_range(measured, value, lo=VALUE_FLOOR, lo_inclusive=False), [key], value))
    nothing = F.lit(None)
    rows = numbers.select(
        key, F.col("value").alias("__value"), nothing.cast("string").alias("__label"), nothing.cast("double").alias("__limit")
    ).unionByName(
        voted.select(
            key,
            nothing.cast("double").alias("__value"),
            F.col(label).alias("__label"),
            (F.col(threshold).try_cast("double") if threshold else nothing.cast("double")).alias("__limit"),
        )
    )
    return drop_groups(label_consensus(rows, [key], "__label", "__value", "__limit", value_name="value"))


def curate_sources(
    records: DataFrame, raw_key: str, value: str, label: str, reference: str = "reference", banned: Sequence[str] = HEAVY_ELEMENTS, sep: str = "."
) -> DataFrame:
    """:func:`curate` from the sources' records on: structures cleaned, thresholds taken from the source.

    An interval is no threshold to decide by; its source's votes count like those of sources
    that state none.
    """
    cleaned = clean_keys(records, raw_key, banned, sep)
    return curate(cleaned.withColumn("__stated", source_threshold(reference)), "key", value, label, "__stated")
