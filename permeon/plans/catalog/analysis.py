"""Aggregates, replicate and label consensus, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from permeon.functions.labels import binarise
from permeon.functions.rounding import min_scale, round_even
from permeon.operators import aggregates, consensus, distribution
from permeon.plans.catalog.inputs import (
    RESULTS,
    SPARSE_EVENTS,
    results,
    sparse_events,
)
from permeon.plans.catalog.registry import Tables, half_even_sql, nullable, query
from permeon.plans.curation import SOURCE_THRESHOLDS, curate_sources
from permeon.session import scratch_dir
from permeon.sources.multi import read_sources


def rounded(df, digits: int, *cols: str):
    """Round the named columns, so that the summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "value_counts",
    """SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS share
    FROM lineitem GROUP BY 1""",
)
def value_counts(spark, d):
    return rounded(aggregates.value_counts(Tables(spark, d).lineitem, "l_returnflag"), 6, "share")


@query("distinct_per_key", "SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1")
def distinct_per_key(spark, d):
    return aggregates.nunique_by(Tables(spark, d).events, "user_id", "event_type")


@query(
    "null_profile",
    f"""WITH {SPARSE_EVENTS}, n AS (SELECT count(*) AS r, count(*) - count(event_id) AS a, count(*) - count(user_id) AS b,
      count(*) - count(event_type) AS c, count(*) FILTER (value IS NULL OR isnan(value)) AS v FROM sparse)
    SELECT 'event_id' AS "column", a AS nulls, round(a / r, 6) AS share FROM n
    UNION ALL SELECT 'user_id', b, round(b / r, 6) FROM n UNION ALL SELECT 'event_type', c, round(c / r, 6) FROM n
    UNION ALL SELECT 'value', v, round(v / r, 6) FROM n""",
)
def null_profile(spark, d):
    return rounded(aggregates.null_profile(sparse_events(spark, d)), 6, "share")


@query(
    "incomplete_rows",
    f"""WITH {SPARSE_EVENTS} SELECT count(*) AS incomplete_rows FROM sparse
    WHERE user_id IS NULL OR event_type IS NULL OR value IS NULL OR isnan(value)""",
)
def incomplete_rows(spark, d):
    return aggregates.count_incomplete_rows(sparse_events(spark, d))


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "describe",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"""
        for c in _DESCRIBED
    ),
)
def describe(spark, d):
    out = aggregates.describe(Tables(spark, d).lineitem, _DESCRIBED)
    return rounded(rounded(out, 4, "mean", "std"), 6, "q25", "q50", "q75")


@query(
    "batch_summary",
    f"""WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (status = 'Success') AS successful,
    count(*) FILTER (status = 'Error') AS failed, round(100.0 * avg((status = 'Success')::INT), 6) AS success_rate,
    count(*) FILTER (prediction = 'BBB+') AS positive_count, count(*) FILTER (prediction = 'BBB-') AS negative_count,
    round(100.0 * count(*) FILTER (prediction = 'BBB+') / count(*) FILTER (status = 'Success'), 6) AS positive_rate,
    round(avg(coalesce(confidence, 0)) FILTER (status = 'Success'), 6) AS avg_confidence,
    round(avg(coalesce(uncertainty, 0)) FILTER (status = 'Success'), 6) AS avg_uncertainty,
    round(avg(coalesce(agreement, 0)) FILTER (status = 'Success'), 6) AS avg_agreement FROM results""",
)
def batch_summary(spark, d):
    out = aggregates.batch_summary(results(spark, d))
    return rounded(out, 6, "success_rate", "positive_rate", "avg_confidence", "avg_uncertainty", "avg_agreement")


@query(
    "class_profile",
    """SELECT p_type, count(*) AS n, round(avg(p_size), 6) AS p_size_mean, round(stddev_samp(p_size), 6) AS p_size_std,
    round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 6) AS p_retailprice_std,
    round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1""",
)
def class_profile(spark, d):
    out = aggregates.class_profile(Tables(spark, d).part, "p_type", ["p_size", "p_retailprice"])
    return rounded(out, 6, "p_size_mean", "p_size_std", "p_retailprice_mean", "p_retailprice_std", "share")


@query(
    "pack_replicates",
    """WITH p AS (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (
      PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS pos FROM lineitem)
    SELECT l_partkey, CAST(pos // 10 AS BIGINT) AS pack, count(*) AS n,
      string_agg(CAST(l_orderkey AS VARCHAR), '|' ORDER BY pos) AS orders,
      string_agg(COALESCE(CAST(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) END AS VARCHAR), 'nan'), '|'
        ORDER BY pos) AS quantities
    FROM p GROUP BY 1, 2""",
)
def pack_replicates(spark, d):
    li = Tables(spark, d).lineitem.withColumn(
        "q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("bigint"))
    )
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    packed = aggregates.pack_replicates(
        li.select("l_partkey", *order, "q"), ["l_partkey"], ["l_orderkey", "q"], order, pack_size=10
    )
    return packed.select(
        "l_partkey",
        "pack",
        "n",
        aggregates.pack_text(F.col("l_orderkey")).alias("orders"),
        aggregates.pack_text(F.col("q")).alias("quantities"),
    )


@query(
    "drop_discordant",
    """WITH k AS (SELECT *, CAST(floor(value / 2) AS BIGINT) AS slot FROM events)
    SELECT event_id, user_id, slot, value FROM k WHERE (user_id, slot) IN (
      SELECT (user_id, slot) FROM k GROUP BY user_id, slot HAVING max(value) - min(value) <= 1)""",
)
def drop_discordant(spark, d):
    k = Tables(spark, d).events.withColumn("slot", F.floor(F.col("value") / 2))
    return aggregates.drop_discordant(k, ["user_id", "slot"], "value").select("event_id", "user_id", "slot", "value")


_CONSENSUS = f"""v AS (SELECT user_id, CAST(floor(value / 2) AS BIGINT) AS slot,
    CAST(round(round_even(value, 2) * 100) AS BIGINT) AS h FROM events),
  s AS (SELECT user_id, slot, min(CASE WHEN h % 10 = 0 THEN 1 ELSE 2 END) AS d FROM v
    GROUP BY user_id, slot HAVING max(h) - min(h) <= 100),
  r AS (SELECT v.user_id, v.slot, d, CASE WHEN d = 2 THEN h ELSE {half_even_sql('h', '10')} END AS u
    FROM v JOIN s ON v.user_id = s.user_id AND v.slot = s.slot),
  c AS (SELECT user_id, slot, d, u, count(*) AS n FROM r GROUP BY ALL),
  a AS (SELECT user_id, slot, d, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * u) AS BIGINT) AS total, min(u) AS lo, max(u) AS hi,
    list(n ORDER BY n DESC, u DESC) AS ns, list(u ORDER BY n DESC, u DESC) AS us FROM c GROUP BY ALL),
  sd AS (SELECT user_id, slot, stddev_pop(u) AS sd FROM r GROUP BY ALL),
  m AS (SELECT a.*, sd, {half_even_sql('total', 'n')} AS mean, CASE WHEN d = 2 THEN 100::DOUBLE ELSE 10::DOUBLE END AS scale
    FROM a JOIN sd ON a.user_id = sd.user_id AND a.slot = sd.slot),
  g AS (SELECT *, CASE WHEN n = 1 THEN 'A' WHEN greatest(hi - mean, mean - lo) * 20 <= abs(mean) THEN 'B'
      WHEN n = 2 THEN 'C' WHEN ns[1] > ns[2] THEN 'D' WHEN len(ns) = 2 THEN 'dropped_G'
      WHEN ns[2] = ns[3] THEN 'dropped_E' ELSE 'dropped_F' END AS grp FROM m)"""


@query(
    "numeric_consensus",
    f"""WITH {_CONSENSUS} SELECT user_id, slot, n, grp AS "group", round(CASE grp WHEN 'D' THEN us[1]::DOUBLE
      WHEN 'dropped_E' THEN (us[1] + us[2] + us[3])::DOUBLE / 3 WHEN 'dropped_F' THEN (us[1] + us[2])::DOUBLE / 2
      ELSE mean::DOUBLE END / scale, 6) AS value,
      round(CASE WHEN n = 1 THEN 0 ELSE sd END / scale, 6) AS std FROM g""",
)
def numeric_consensus(spark, d):
    e = Tables(spark, d).events.withColumn("slot", F.floor(F.col("value") / 2))
    return rounded(consensus.numeric_consensus(e, ["user_id", "slot"], "value"), 6, "value", "std")


@query(
    "drop_failed_groups",
    f"""WITH {_CONSENSUS} SELECT user_id, slot, grp AS "group" FROM g WHERE NOT contains(grp, 'dropped')""",
)
def drop_failed_groups(spark, d):
    e = Tables(spark, d).events.withColumn("slot", F.floor(F.col("value") / 2))
    return consensus.drop_groups(consensus.numeric_consensus(e, ["user_id", "slot"], "value")).select(
        "user_id", "slot", "group"
    )


def _votes(spark, d):
    return Tables(spark, d).lineitem.select(
        "l_partkey",
        "l_linenumber",
        "l_linestatus",
        F.when(F.col("l_quantity") == 50, F.col("l_discount") * 20 - 2).alias("measured"),
        F.when(F.col("l_suppkey") < 20, -1.0).when(F.col("l_suppkey") > 90, 0.1).alias("threshold"),
    )


@query(
    "label_consensus",
    """WITH v AS (SELECT l_partkey, l_linenumber, l_linestatus AS label,
      CASE WHEN l_quantity = 50 THEN l_discount * 20 - 2 END AS measured,
      CASE WHEN l_suppkey < 20 THEN -1.0 WHEN l_suppkey > 90 THEN 0.1 END AS threshold FROM lineitem),
    k AS (SELECT l_partkey, l_linenumber, min(measured) AS measured, min(threshold) AS threshold FROM v GROUP BY ALL),
    c AS (SELECT l_partkey, l_linenumber, label, count(*) AS n FROM v WHERE measured IS NULL GROUP BY ALL),
    t AS (SELECT l_partkey, l_linenumber, count(*) AS kinds, list(n ORDER BY n DESC, label) AS ns,
      list(label ORDER BY n DESC, label) AS ls FROM c GROUP BY ALL)
    SELECT k.l_partkey, k.l_linenumber,
      CASE WHEN measured >= -1 THEN 'BBB+' WHEN measured IS NOT NULL THEN 'BBB-' WHEN kinds = 1 THEN ls[1]
        WHEN threshold = -1 THEN '' WHEN ns[1] > ns[2] THEN ls[1] ELSE '' END AS label,
      CASE WHEN measured IS NOT NULL THEN 'A' WHEN threshold = -1 AND kinds = 1 THEN 'B'
        WHEN threshold = -1 THEN 'dropped_group1' WHEN kinds = 1 THEN 'C' WHEN ns[1] > ns[2] THEN 'D'
        ELSE 'dropped_group2' END AS "group"
    FROM k LEFT JOIN t ON k.l_partkey = t.l_partkey AND k.l_linenumber = t.l_linenumber""",
)
def label_consensus(spark, d):
    return consensus.label_consensus(
        _votes(spark, d), ["l_partkey", "l_linenumber"], "l_linestatus", "measured", "threshold"
    )


@query(
    "threshold_binarise",
    "SELECT c_custkey, CASE WHEN c_acctbal >= -1 THEN 'BBB+' ELSE 'BBB-' END AS label FROM customer",
)
def threshold_binarise(spark, d):
    return Tables(spark, d).customer.select("c_custkey", binarise("c_acctbal").alias("label"))


@query(
    "pick_name",
    """WITH p AS (SELECT p_brand, lower(CASE WHEN p_size > 45 AND p_name LIKE 'r%' THEN p_name END) AS a,
      lower(CASE WHEN p_type = 'PROMO' AND p_size = 7 THEN p_type END) AS b, p_name AS alt, p_partkey FROM part)
    SELECT p_brand, COALESCE(min(a), min(b), arg_min(alt, p_partkey), '') AS picked_name FROM p GROUP BY 1""",
)
def pick_name(spark, d):
    p = Tables(spark, d).part.select(
        "p_brand",
        "p_partkey",
        F.when((F.col("p_size") > 45) & F.col("p_name").startswith("r"), F.upper("p_name")).otherwise("nan").alias("a"),
        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") == 7), F.col("p_type")).otherwise("123").alias("b"),
        F.col("p_name").alias("alt"),
    )
    return consensus.pick_name(p, ["p_brand"], "a", "b", "alt", ["p_partkey"], drop_single=True)


@query(
    "pick_id",
    "SELECT l_orderkey, CAST(min(CASE WHEN l_linenumber > 1 THEN l_partkey END) AS DOUBLE) AS picked_id FROM lineitem GROUP BY 1",
)
def pick_id(spark, d):
    li = Tables(spark, d).lineitem.select(
        "l_orderkey",
        F.when(F.col("l_linenumber") > 1, F.concat(F.col("l_partkey"), F.lit(".0"))).otherwise("nan").alias("cid"),
    )
    return nullable(consensus.pick_id(li, ["l_orderkey"], "cid"), "picked_id")


@query(
    "pick_text",
    "SELECT l_orderkey, min(CASE WHEN l_linenumber > 1 THEN 'S' || l_suppkey END) AS picked_key FROM lineitem GROUP BY 1",
)
def pick_text(spark, d):
    li = Tables(spark, d).lineitem.select(
        "l_orderkey",
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("S"), F.col("l_suppkey"))).otherwise("nan").alias("smiles"),
    )
    return consensus.pick_text(li, ["l_orderkey"], "smiles")


@query(
    "task_split",
    f"""WITH {SPARSE_EVENTS} SELECT 'measured' AS task, count(*) AS n, round(sum(value), 2) AS total FROM sparse
    WHERE value IS NOT NULL AND NOT isnan(value)
    UNION ALL SELECT 'labelled', count(*), NULL FROM sparse WHERE value IS NULL OR isnan(value)""",
)
def task_split(spark, d):
    measured, rest = aggregates.split_by_presence(sparse_events(spark, d), "value")
    a = measured.agg(F.lit("measured").alias("task"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    b = rest.agg(F.lit("labelled").alias("task"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return a.unionByName(b)


_LIMITS = " ".join(f"WHEN '{r}' THEN {t}::DOUBLE" for r, t in SOURCE_THRESHOLDS.items() if not t.startswith("("))
_FROM_SOURCES = _CONSENSUS.replace("CAST(floor(value / 2) AS BIGINT) AS slot", "slot").replace("FROM events)", "FROM measured)")


@query(
    "curation_chain",
    f"""WITH src AS (SELECT user_id, CAST(floor(value / 2) AS BIGINT) AS slot, 'R' || (user_id % 30 + 1) AS reference,
      CASE WHEN event_type IN ('click', 'view') THEN value - 5 END AS value, CASE WHEN event_id % 3 = 0 THEN 'BBB-' ELSE 'BBB+' END AS label
      FROM events WHERE event_id % 7 <> 3 AND user_id % 19 <> 0),
    measured AS (SELECT user_id, slot, value FROM src WHERE value > -9), {_FROM_SOURCES},
    numbers AS (SELECT user_id, slot, CASE grp WHEN 'D' THEN us[1]::DOUBLE ELSE mean::DOUBLE END / scale AS value FROM g WHERE NOT contains(grp, 'dropped')),
    votes AS (SELECT user_id, slot, label, CASE reference {_LIMITS} END AS stated FROM src WHERE value IS NULL),
    k AS (SELECT user_id, slot, min(value) AS measured, min(stated) AS threshold FROM (SELECT user_id, slot, value, NULL AS stated FROM numbers
      UNION ALL SELECT user_id, slot, NULL, stated FROM votes) GROUP BY ALL),
    c2 AS (SELECT user_id, slot, label, count(*) AS n FROM votes GROUP BY ALL),
    t AS (SELECT user_id, slot, count(*) AS kinds, list(n ORDER BY n DESC, label) AS ns, list(label ORDER BY n DESC, label) AS ls FROM c2 GROUP BY ALL),
    f AS (SELECT k.user_id, k.slot, measured, CASE WHEN measured >= -1 THEN 'BBB+' WHEN measured IS NOT NULL THEN 'BBB-' ELSE ls[1] END AS label,
      CASE WHEN measured IS NOT NULL THEN 'A' WHEN threshold = -1 AND kinds = 1 THEN 'B' WHEN threshold = -1 THEN 'dropped_group1'
        WHEN kinds = 1 THEN 'C' WHEN ns[1] > ns[2] THEN 'D' ELSE 'dropped_group2' END AS grp
      FROM k LEFT JOIN t ON k.user_id = t.user_id AND k.slot = t.slot)
    SELECT 'c' || user_id || 'n' || slot AS key, round(measured, 6) AS value, label, grp AS "group" FROM f WHERE NOT contains(grp, 'dropped')""",
)
def curation_chain(spark, d):
    """From the folders of thirty sources, read as one table, to one labelled row for each structure."""
    user, slot = F.col("user_id"), F.floor(F.col("value") / 2)
    body = F.concat(F.lit("C"), user, F.lit("N"), slot)
    spelled = F.when(user % 19 == 0, F.concat(F.lit("[Hg]"), body)).when(F.col("event_id") % 2 == 0, F.concat(body, F.lit(".Cl"))).otherwise(F.concat(F.lit(" "), F.lower(body)))
    records = Tables(spark, d).events.select(
        F.concat(F.lit("R"), user % 30 + 1).alias("source"),
        F.when(F.col("event_id") % 7 != 3, spelled).alias("smiles"),
        F.when(F.col("event_type").isin("click", "view"), F.col("value") - 5).alias("logBB"),
        F.when(F.col("event_id") % 3 == 0, "BBB-").otherwise("BBB+").alias("label"),
    )
    path = scratch_dir(spark, "sources")
    records.write.partitionBy("source").json(path)
    read = read_sources(spark, f"{path}/*", records.drop("source").schema)
    return rounded(curate_sources(read, "smiles", "logBB", "label"), 6, "value")


@query(
    "histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT b.bin, round(lo + b.bin * w, 6) AS lo, round(lo + (b.bin + 1) * w, 6) AS hi, COALESCE(n, 0) AS n
    FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
)
def histogram(spark, d):
    return rounded(distribution.histogram(Tables(spark, d).lineitem, "l_extendedprice", 10), 6, "lo", "hi")


@query(
    "discrete_histogram",
    "SELECT CAST(l_quantity AS BIGINT) AS bin, l_quantity - 0.5 AS lo, l_quantity + 0.5 AS hi, count(*) AS n FROM lineitem GROUP BY l_quantity",
)
def discrete_histogram(spark, d):
    return distribution.histogram(Tables(spark, d).lineitem, "l_quantity", discrete=True).select(
        "bin", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n"
    )


@query(
    "ecdf",
    """SELECT value AS x, count(*) AS n, round(sum(count(*)) OVER (ORDER BY value) / (SELECT count(*) FROM events), 9) AS proportion
    FROM events GROUP BY value""",
)
def ecdf(spark, d):
    return rounded(distribution.ecdf(Tables(spark, d).events, "value"), 9, "proportion")


@query(
    "scatter_rows",
    f"""WITH {RESULTS} SELECT o_orderkey, COALESCE(prediction, 'Unknown') AS trace, COALESCE(confidence, 0) AS x,
    COALESCE(uncertainty, 0) AS y, COALESCE(name, 'Unknown') AS text FROM results WHERE status = 'Success'""",
)
def scatter(spark, d):
    rows = results(spark, d).withColumn("name", F.coalesce("name", F.lit("Unknown")))
    return distribution.scatter_rows(rows, keep=["o_orderkey"])


@query(
    "metric_unpivot",
    """WITH m AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 3) AS mean_price,
      CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1)
    SELECT model, 'mean_price' AS metric, mean_price AS value FROM m UNION ALL SELECT model, 'n_orders', n_orders FROM m""",
)
def metric_unpivot(spark, d):
    m = Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg("o_totalprice"), 3).alias("mean_price"), F.count(F.lit(1)).alias("n_orders")
    )
    return distribution.metrics_long(m, ["model"], ["mean_price", "n_orders"])


@query(
    "fewest_decimals",
    """SELECT user_id, CAST(min(CASE WHEN contains(CAST(value AS VARCHAR), '.')
      THEN length(split_part(CAST(value AS VARCHAR), '.', 2)) ELSE 0 END) AS INTEGER) AS decimals
    FROM events GROUP BY 1""",
)
def fewest_decimals(spark, d):
    per_row = Tables(spark, d).events.select("user_id", min_scale(F.array(F.col("value").cast("string"))).alias("s"))
    return per_row.groupBy("user_id").agg(F.min("s").alias("decimals"))


@query("half_even_rounding", "SELECT event_id, round_even(value, 1) AS rounded FROM events")
def half_even_rounding(spark, d):
    return Tables(spark, d).events.select("event_id", round_even("value", 1).alias("rounded"))
