"""Projection of nested payload cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOLECULE_PAYLOAD = T.StructType(
    [
        T.StructField("molecule_chembl_id", T.StringType()),
        T.StructField("pref_name", T.StringType()),
        T.StructField("molecule_type", T.StringType()),
        T.StructField("max_phase", T.StringType()),
        T.StructField(
            "molecule_structures", T.StructType([T.StructField("canonical_smiles", T.StringType())])
        ),
    ]
)
SEARCH_PAYLOAD = T.StructType([T.StructField("molecules", T.ArrayType(MOLECULE_PAYLOAD))])
REFERENCES = T.MapType(
    T.StringType(),
    T.ArrayType(T.StructType([T.StructField("ref_id", T.StringType()), T.StructField("ref_url", T.StringType())])),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project_payload(payload: Column | str, fallback_name: Column | str) -> Column:
    """First hit of a search answer as a struct; NULL where nothing was found.

    The preferred name falls back to the input; a missing structure block gives
    a NULL structure instead of an error.
    """
    hit = F.get(F.from_json(_col(payload), SEARCH_PAYLOAD)["molecules"], F.lit(0))
    return F.when(
        hit.isNotNull(),
        F.struct(
            hit["molecule_chembl_id"].alias("hit_id"),
            F.coalesce(F.when(hit["pref_name"] != "", hit["pref_name"]), _col(fallback_name)).alias("name"),
            hit["molecule_type"].alias("molecule_type"),
            hit["molecule_structures"]["canonical_smiles"].alias("smiles"),
            hit["max_phase"].alias("max_phase"),
        ),
    )


def json_field(payload: Column | str, path: str, dtype: str = "string") -> Column:
    """One scalar out of a JSON cell; absent or malformed gives NULL."""
    return F.get_json_object(_col(payload), path).try_cast(dtype)


def reference_cell(cell: Column | str) -> Column:
    """Single-quoted nested cell to map(source -> list of references)."""
    return F.from_json(_col(cell), REFERENCES, {"allowSingleQuotes": "true"})


def property_cell(cell: Column | str) -> Column:
    """``K = v | K = v`` to a map."""
    entries = F.transform(
        F.split(_col(cell), r"\|"),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
        ),
    )
    return F.map_from_entries(entries)
