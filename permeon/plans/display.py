"""Result tables for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeon.functions.rounding import fixed


def format_results(results: DataFrame, key: str) -> DataFrame:
    """Fixed columns, 1 or 2 decimals, ``N/A`` for what is missing, and the error text."""
    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    return results.select(
        key,
        text("input", "").alias("Input"),
        text("name", "").alias("Name"),
        text("status", "Unknown").alias("Status"),
        text("prediction", "N/A").alias("Prediction"),
        fixed("confidence", 1).alias("Confidence"),
        fixed("uncertainty", 1).alias("Uncertainty"),
        fixed("agreement", 1).alias("Agreement"),
        fixed("molecular_weight", 1).alias("MW"),
        fixed("logp", 2).alias("LogP"),
        text("smiles", "N/A").alias("SMILES"),
        F.when(F.col("status") == "Error", text("error", "Unknown error")).alias("Error"),
    )


def chat_export(chat: DataFrame, by: list[str], order: str, role: str, message: str, subject, timestamp=None) -> DataFrame:
    """Chat log rows with a title-cased role, in turn order."""
    cols = [F.col(c) for c in [*by, order]]
    if timestamp is not None:
        cols.append(timestamp.alias("Timestamp"))
    out = chat.select(*cols, F.initcap(role).alias("Role"), F.col(message).alias("Message"), subject.alias("Subject"))
    return out.orderBy(*by, order)


def pending_question(chat: DataFrame, by: list[str], order: str, role: str, message: str) -> DataFrame:
    """The last message of each conversation that ends with the user."""
    last = chat.groupBy(*by).agg(F.max_by(F.struct(role, message), F.col(order)).alias("m"))
    return last.filter(F.col(f"m.{role}") == "user").select(*by, F.col(f"m.{message}").alias("question"))
