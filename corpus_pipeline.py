"""The corpus pipeline: from raw documents to packed training pieces.

Each stage takes (spark, documents, folder) and works on all rows that the stage
before has kept. A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.llm.common import remainder, stored, table
from permeon.llm.decontamination import drop_contaminated
from permeon.llm.language_id import UNKNOWN, fit_language_model, identify_language
from permeon.llm.near_copies import one_of_near_copies
from permeon.llm.packing import pack
from permeon.llm.suffix_dedup import remove_repeats

#: A text goes if its language is unknown or less likely than this.
LEAST_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the folds are those of the language query."""
    model = fit_language_model(docs.where(remainder("doc_id", 4) != 2))
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = identify_language(rows, model, ["row"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: SimHash components and MinHash bands as candidates, verified by five-word shingles (similarity of at least 0.8)."""
    return one_of_near_copies(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one has."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no considerable part of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their token ids beside the digests."""
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", repeat_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Hashing, model fits and tokenisation are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
