"""Finding the key and name columns of an uploaded table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted column names, in order of preference, and the error text.
KEY_COLUMN = "smiles"
NAME_COLUMN = "name"
MISSING_COLUMNS = "CSV must contain either 'smiles'/'Smiles' or 'name'/'Name' column"


@dataclass(frozen=True)
class ResolvedColumns:
    """Which column holds the entity and which its display name; ``mode`` is what the entity is."""

    key: str
    name: str
    mode: str


def resolve_columns(df: DataFrame) -> ResolvedColumns:
    """Case-insensitive match, structure before name; the last matching column wins."""
    found = {c.lower(): c for c in df.columns}
    if KEY_COLUMN in found:
        return ResolvedColumns(found[KEY_COLUMN], found.get(NAME_COLUMN, found[KEY_COLUMN]), "smiles")
    if NAME_COLUMN in found:
        return ResolvedColumns(found[NAME_COLUMN], found[NAME_COLUMN], "name")
    raise ValueError(MISSING_COLUMNS)


def as_batch_input(df: DataFrame, *carry: str) -> DataFrame:
    """Project an uploaded table to (input, name), keeping the ``carry`` columns in front."""
    cols = resolve_columns(df)
    return df.select(*carry, F.col(f"`{cols.key}`").alias("input"), F.col(f"`{cols.name}`").alias("name"))
