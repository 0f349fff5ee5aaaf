"""Label codecs, thresholds and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts and decision thresholds of the permeability task.
POSITIVE = "BBB+"
NEGATIVE = "BBB-"
LOGBB_CUTOFF = -1.0
UNCERTAINTY_EDGES = (10.0, 25.0)
UNCERTAINTY_NAMES = ("low", "medium", "high")
CONFIDENCE_LOW = 60.0
CONFIDENCE_HIGH = 80.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label(c: Column | str, positive: str = POSITIVE) -> Column:
    """1 for the positive text, otherwise 0 (missing included)."""
    return F.when(_col(c) == positive, 1).otherwise(0)


def decode_label(c: Column | str, positive: str = POSITIVE, negative: str = NEGATIVE) -> Column:
    """1 to the positive text, everything else to the negative one."""
    return F.when(_col(c) == 1, positive).otherwise(negative)


def decode_vote(c: Column | str, positive: str = POSITIVE, negative: str = NEGATIVE) -> Column:
    """As :func:`decode_label`, but a model that gave no 0/1 answer shows ``N/A``."""
    c = _col(c)
    return F.when(c == 1, positive).when(c == 0, negative).otherwise("N/A")


def binarise(
    c: Column | str, threshold: float = LOGBB_CUTOFF, positive: str = POSITIVE, negative: str = NEGATIVE
) -> Column:
    """Measured value at or above the threshold is positive; missing stays missing."""
    c = _col(c)
    return F.when(c >= threshold, positive).when(c.isNotNull(), negative)


def band(c: Column | str, edges: Sequence[float], names: Sequence[str]) -> Column:
    """``names[i]`` for the first edge strictly above the value, else the last name."""
    c = _col(c)
    out = None
    for edge, name in zip(edges, names):
        out = F.when(c < edge, name) if out is None else out.when(c < edge, name)
    return out.when(c.isNotNull(), names[-1])


def uncertainty_band(c: Column | str) -> Column:
    return band(c, UNCERTAINTY_EDGES, UNCERTAINTY_NAMES)


def confidence_band(c: Column | str) -> Column:
    """Above 80 high, 60 to 80 medium (both ends included), below 60 low."""
    c = _col(c)
    return (
        F.when(c > CONFIDENCE_HIGH, "high")
        .when(c >= CONFIDENCE_LOW, "medium")
        .when(c.isNotNull(), "low")
    )


def map_lookup(c: Column | str, table: Mapping) -> Column:
    """Small constant dictionary as a literal map; an unknown key gives NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(c))
