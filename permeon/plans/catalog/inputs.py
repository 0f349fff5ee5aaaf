"""Shared inputs derived from the tables: nulled views and a long score table, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.operators.scoring import long_scores
from permeon.plans.catalog.registry import Tables

NAN = "'NaN'::DOUBLE"
MODELS = ("KNN", "LGBM", "ET", "XGB", "SVM")


def sparse_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with missing cells: NULL and NaN values, missing users and types."""
    e = Tables(spark, d).events
    return e.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
    )


SPARSE_EVENTS = f"""sparse AS (SELECT event_id,
  CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN {NAN} ELSE value END AS value
  FROM events)"""


def sparse_items(spark: SparkSession, d: str) -> DataFrame:
    """Line items with NULL, NaN and infinite cells, and a column without values."""
    li = Tables(spark, d).lineitem
    return li.select(
        "l_orderkey",
        "l_partkey",
        F.when(F.col("l_returnflag") == "A", F.lit(None))
        .when(F.col("l_linenumber") == 7, F.lit(float("inf")))
        .otherwise(F.col("l_quantity"))
        .alias("qty"),
        F.when(F.col("l_linenumber") == 6, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 5, F.lit(float("-inf")))
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"),
        F.lit(None).cast("double").alias("empty"),
    )


SPARSE_ITEMS = f"""sparse AS (SELECT l_orderkey, l_partkey,
  CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS qty,
  CASE WHEN l_linenumber = 6 THEN {NAN} WHEN l_linenumber = 5 THEN '-Infinity'::DOUBLE ELSE l_extendedprice END AS price,
  CASE WHEN l_returnflag = 'R' THEN l_tax END AS tax,
  NULL::DOUBLE AS empty
  FROM lineitem)"""


def scores(spark: SparkSession, d: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(event_id, actual, model, pred, p1) for every event; SVM never has a probability, ET not on errors."""
    e = Tables(spark, d).events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    cents, eid, uid = F.col("cents"), F.col("event_id"), F.col("user_id")
    actual = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)
    share = lambda x: (x % 101).cast("double") / F.lit(100.0)
    up = lambda p: F.when(p >= 0.5, 1).otherwise(0)
    known = F.col("event_type") != "error"
    p = {
        "KNN": share(cents * 7),
        "LGBM": share(cents * 13 + eid),
        "ET": F.when(known, share(eid * 31 + uid * 17)),
        "XGB": share(cents * 5 + uid),
    }
    answers = {m: (up(p[m]), p[m]) for m in ("KNN", "LGBM", "XGB")}
    answers["ET"] = (F.when(known, up(p["ET"])).otherwise((uid % 2).cast("int")), p["ET"])
    answers["SVM"] = (((eid * 3 + cents) % 2).cast("int"), F.lit(None).cast("double"))
    return long_scores(
        e.withColumn("actual", actual), "event_id", {m: answers[m] for m in models}, keep=["actual"]
    )


def scores_sql(models: tuple[str, ...] = MODELS) -> str:
    cents = "CAST(round(value * 100) AS BIGINT)"
    share = lambda x: f"CAST(({x}) % 101 AS DOUBLE) / 100::DOUBLE"
    p = {
        "KNN": share(f"{cents} * 7"),
        "LGBM": share(f"{cents} * 13 + event_id"),
        "ET": f"CASE WHEN event_type <> 'error' THEN {share('event_id * 31 + user_id * 17')} END",
        "XGB": share(f"{cents} * 5 + user_id"),
        "SVM": "NULL::DOUBLE",
    }
    pred = {m: f"CASE WHEN {p[m]} >= 0.5 THEN 1 ELSE 0 END" for m in ("KNN", "LGBM", "XGB")}
    pred["ET"] = f"CASE WHEN event_type = 'error' THEN user_id % 2 WHEN {p['ET']} >= 0.5 THEN 1 ELSE 0 END"
    pred["SVM"] = f"(event_id * 3 + {cents}) % 2"
    parts = [
        f"SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS actual, "
        f"'{m}' AS model, CAST({pred[m]} AS INTEGER) AS pred, {p[m]} AS p1 FROM events"
        for m in models
    ]
    return "scores AS (" + "\nUNION ALL ".join(parts) + ")"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as batch results: status, prediction, confidence, and properties."""
    o = Tables(spark, d).orders
    ok = F.col("o_orderstatus") != "P"
    pct = (F.col("o_orderkey") * 37 % 1000).cast("double") / F.lit(10.0)
    return o.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("input"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("C"), F.col("o_custkey"))).alias("name"),
        F.when(ok, "Success").otherwise("Error").alias("status"),
        F.when(~ok, "Could not process molecule").alias("error"),
        F.when(F.col("o_orderstatus") == "O", "BBB+").when(F.col("o_orderstatus") == "F", "BBB-").alias("prediction"),
        F.when(ok, pct).alias("confidence"),
        F.when(ok & (F.col("o_orderpriority") != "2-HIGH"), F.lit(100.0) - pct).alias("uncertainty"),
        F.when(ok, F.lit(50.0) + pct / 2).alias("agreement"),
        F.when(ok, (F.col("o_custkey") % 900).cast("double")).alias("molecular_weight"),
        F.when(ok, (F.col("o_custkey") % 70).cast("double") / F.lit(8.0)).alias("logp"),
        F.when(ok, F.col("o_orderpriority")).alias("smiles"),
    )


RESULTS = """results AS (SELECT o_orderkey, o_orderpriority AS input,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 'C' || o_custkey END AS name,
  CASE WHEN o_orderstatus <> 'P' THEN 'Success' ELSE 'Error' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'Could not process molecule' END AS error,
  CASE o_orderstatus WHEN 'O' THEN 'BBB+' WHEN 'F' THEN 'BBB-' END AS prediction,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 10::DOUBLE END AS confidence,
  CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH'
       THEN 100::DOUBLE - CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 10::DOUBLE END AS uncertainty,
  CASE WHEN o_orderstatus <> 'P' THEN 50::DOUBLE + CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 10::DOUBLE / 2 END AS agreement,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 900 AS DOUBLE) END AS molecular_weight,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 70 AS DOUBLE) / 8::DOUBLE END AS logp,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS smiles
  FROM orders)"""
