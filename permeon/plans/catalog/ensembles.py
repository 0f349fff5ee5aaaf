"""Ensembles, display tables and evaluation over the long score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from permeon.functions.labels import confidence_band, uncertainty_band
from permeon.operators import evaluation, scoring
from permeon.operators.aggregates import batch_summary
from permeon.plans.batch_scoring import order_for_display, resolve_inputs, score_batch
from permeon.plans.catalog.analysis import rounded
from permeon.plans.catalog.inputs import RESULTS, results, scores, scores_sql
from permeon.plans.catalog.registry import Tables, nullable, query
from permeon.plans.display import format_results

THREE = ("KNN", "LGBM", "ET")
_fold = lambda x: f"CASE WHEN {x} < 50 THEN 100 - {x} ELSE {x} END"
_BATCH = """votes AS (SELECT event_id, CASE WHEN avg(pred) >= 0.5 THEN 'BBB+' ELSE 'BBB-' END AS prediction,
    COALESCE(avg(p1) * 100, 50) AS confidence,
    CASE WHEN count(p1) > 1 THEN stddev_pop(p1) * 100 ELSE abs(50 - COALESCE(avg(p1) * 100, 50)) END AS uncertainty,
    CASE WHEN avg(pred) * 100 < 50 THEN 100 - avg(pred) * 100 ELSE avg(pred) * 100 END AS agreement,
    count(*) AS num_models FROM scores GROUP BY event_id)"""
_ENSEMBLE_COLUMNS = """round(confidence, 6) AS confidence, round(uncertainty, 6) AS uncertainty,
    round(agreement, 6) AS agreement, num_models"""


@query(
    "scored_batch_summary",
    f"""WITH {scores_sql(THREE)}, {_BATCH},
    b AS (SELECT *, CASE WHEN round(uncertainty, 9) < 10 THEN 'low' WHEN round(uncertainty, 9) < 25 THEN 'medium' ELSE 'high' END AS band FROM votes)
    SELECT band, count(*) AS total, count(*) AS successful, count(*) FILTER (prediction = 'BBB+') AS positive_count,
    round(100.0 * count(*) FILTER (prediction = 'BBB+') / count(*), 6) AS positive_rate,
    round(avg(confidence), 6) AS avg_confidence, round(avg(uncertainty), 6) AS avg_uncertainty,
    round(avg(agreement), 6) AS avg_agreement FROM b GROUP BY band""",
)
def scored_batch_summary(spark, d):
    votes = scoring.ensemble_vote_batch(scores(spark, d, THREE), "event_id")
    banded = votes.withColumn("band", uncertainty_band(F.round("uncertainty", 9))).withColumn("status", F.lit("Success"))
    out = batch_summary(banded, by=["band"]).drop("failed", "success_rate", "negative_count")
    return rounded(out, 6, "positive_rate", "avg_confidence", "avg_uncertainty", "avg_agreement")


@query(
    "ensemble_mean",
    f"""WITH {scores_sql(THREE)}, e AS (SELECT event_id, CASE WHEN round(avg(p1), 12) > 0.5 THEN 'BBB+' ELSE 'BBB-' END AS prediction,
      greatest(avg(p1), 1 - avg(p1)) * 100 AS confidence, stddev_pop(p1) * 100 AS uncertainty,
      {_fold('avg(pred) * 100')} AS agreement, count(*) AS num_models FROM scores WHERE p1 IS NOT NULL GROUP BY event_id)
    SELECT event_id, prediction, {_ENSEMBLE_COLUMNS} FROM e""",
)
def ensemble_mean(spark, d):
    out = scoring.ensemble_mean(scores(spark, d, THREE), "event_id")
    return rounded(out, 6, "confidence", "uncertainty", "agreement")


@query(
    "ensemble_vote_batch",
    f"WITH {scores_sql(THREE)}, {_BATCH} SELECT event_id, prediction, {_ENSEMBLE_COLUMNS} FROM votes",
)
def ensemble_vote_batch(spark, d):
    out = scoring.ensemble_vote_batch(scores(spark, d, THREE), "event_id")
    return rounded(out, 6, "confidence", "uncertainty", "agreement")


@query(
    "ensemble_vote_agree",
    f"""WITH {scores_sql(THREE)}, m AS (SELECT event_id, CASE WHEN avg(pred) >= 0.5 THEN 1 ELSE 0 END AS maj,
      count(*) AS num_models FROM scores GROUP BY event_id)
    SELECT m.event_id, CASE WHEN maj = 1 THEN 'BBB+' ELSE 'BBB-' END AS prediction,
      round(COALESCE(avg(greatest(p1, 1 - p1) * 100) FILTER (pred = maj AND p1 IS NOT NULL), 50), 6) AS confidence, num_models
    FROM m JOIN scores s ON m.event_id = s.event_id GROUP BY m.event_id, maj, num_models""",
)
def ensemble_vote_agree(spark, d):
    return rounded(scoring.ensemble_vote_agree(scores(spark, d, THREE), "event_id"), 6, "confidence")


@query(
    "majority_vote",
    f"""WITH {scores_sql()} SELECT event_id, CAST(sum(pred) AS BIGINT) AS votes,
    CASE WHEN sum(pred) >= 3 THEN 'BBB+' ELSE 'BBB-' END AS prediction FROM scores GROUP BY event_id""",
)
def majority_vote(spark, d):
    return scoring.majority(scores(spark, d), "event_id")


@query(
    "ensemble_count",
    f"""WITH {scores_sql(('KNN', 'LGBM', 'ET', 'SVM'))} SELECT event_id,
    CASE WHEN count(*) FILTER (pred = 1) >= count(*) FILTER (pred = 0) THEN 'BBB+' ELSE 'BBB-' END AS prediction,
    round(COALESCE(avg(p1) * 100, 0), 6) AS confidence FROM scores GROUP BY event_id""",
)
def ensemble_count(spark, d):
    return rounded(scoring.ensemble_count(scores(spark, d, ("KNN", "LGBM", "ET", "SVM")), "event_id"), 6, "confidence")


@query(
    "primary_model",
    f"""WITH {scores_sql()}, s AS (SELECT * FROM scores WHERE model <> 'XGB' OR actual = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY model <> 'XGB', model) AS rn FROM s)
    SELECT event_id, model, CASE WHEN pred = 1 THEN 'BBB+' ELSE 'BBB-' END AS prediction,
      round(CASE WHEN pred = 1 THEN p1 ELSE 1 - p1 END * 100, 6) AS confidence FROM r WHERE rn = 1""",
)
def primary_model(spark, d):
    s = scores(spark, d).filter((F.col("model") != "XGB") | (F.col("actual") == 1))
    return rounded(scoring.primary_score(s, "event_id"), 6, "confidence")


@query(
    "predictions_wide",
    f"""WITH {scores_sql(THREE)} SELECT event_id, max(actual) AS actual,
    max(pred) FILTER (model = 'KNN') AS "KNN", max(p1) FILTER (model = 'KNN') AS "KNN_proba",
    max(pred) FILTER (model = 'LGBM') AS "LGBM", max(p1) FILTER (model = 'LGBM') AS "LGBM_proba",
    max(pred) FILTER (model = 'ET') AS "ET", max(p1) FILTER (model = 'ET') AS "ET_proba" FROM scores GROUP BY event_id""",
)
def predictions_wide(spark, d):
    actual = Tables(spark, d).events.select(
        "event_id", F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("actual")
    )
    return scoring.predictions_wide(scores(spark, d, THREE), "event_id", THREE, actual)


@query(
    "export_rows",
    f"""WITH {scores_sql(THREE)}, w AS (SELECT event_id,
      max(pred) FILTER (model = 'LGBM') AS g, max(greatest(p1, 1 - p1)) FILTER (model = 'LGBM' AND p1 IS NOT NULL) AS gp,
      max(pred) FILTER (model = 'KNN') AS k, max(greatest(p1, 1 - p1)) FILTER (model = 'KNN' AND p1 IS NOT NULL) AS kp,
      max(pred) FILTER (model = 'ET') AS e, max(greatest(p1, 1 - p1)) FILTER (model = 'ET' AND p1 IS NOT NULL) AS ep,
      count(*) FILTER (pred = 1) AS ones, count(*) FILTER (pred = 0) AS zeros FROM scores GROUP BY 1)
    SELECT ev.event_id, event_type, value, CASE WHEN k = 1 THEN 'BBB+' ELSE 'BBB-' END AS "KNN_prediction",
      round(kp * 100, 6) AS "KNN_confidence", CASE WHEN e = 1 THEN 'BBB+' ELSE 'BBB-' END AS "ET_prediction",
      CASE WHEN g = 1 THEN 'BBB+' ELSE 'BBB-' END AS "LGBM_prediction", round(gp * 100, 6) AS "LGBM_confidence",
      round(ep * 100, 6) AS "ET_confidence", CASE WHEN ones >= zeros THEN 'BBB+' ELSE 'BBB-' END AS ensemble_prediction
    FROM events ev JOIN w ON ev.event_id = w.event_id""",
)
def export_rows(spark, d):
    info = Tables(spark, d).events.select("event_id", "event_type", "value")
    out = scoring.export_row(scores(spark, d, THREE), "event_id", list(THREE), info)
    return rounded(out, 6, *(f"{m}_confidence" for m in THREE))


@query(
    "model_table",
    f"""WITH {scores_sql()} SELECT event_id, model, CASE pred WHEN 1 THEN 'BBB+' WHEN 0 THEN 'BBB-' ELSE 'N/A' END AS prediction,
    CASE WHEN p1 IS NULL THEN 'N/A' ELSE printf('%.1f', round_even(greatest(p1, 1 - p1) * 100, 1)) END AS confidence FROM scores""",
)
def model_table(spark, d):
    return scoring.model_table(scores(spark, d), "event_id")


@query(
    "softmax_head",
    """WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS a, embedding[2]::DOUBLE * 5 AS b FROM embeddings),
    p AS (SELECT vec_id, a, b, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p1 FROM l)
    SELECT vec_id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1, round(greatest(p1, 1 - p1), 6) AS confidence,
      CASE WHEN b > a THEN 1 ELSE 0 END AS prediction, b > a AS permeable, greatest(p1, 1 - p1) >= 0.7 AS reliable FROM p""",
)
def softmax_head(spark, d):
    logits = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") * 5)
    out = scoring.softmax_head(Tables(spark, d).embeddings, logits)
    p = F.col("probabilities")
    return out.select(
        "vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"),
        F.round("confidence", 6).alias("confidence"), "prediction", "permeable", "reliable",
    )


@query(
    "confidence_bands",
    """SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 25 THEN 'medium' ELSE 'high' END AS uncertainty_band,
    CASE WHEN value > 80 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS confidence_band FROM events""",
)
def confidence_bands(spark, d):
    return Tables(spark, d).events.select(
        "event_id", uncertainty_band("value").alias("uncertainty_band"), confidence_band("value").alias("confidence_band")
    )


@query(
    "rule_screen",
    """WITH p AS (SELECT l_orderkey, l_extendedprice / 100 AS mw, l_quantity / 10 AS logp, l_linenumber AS hbd,
      l_discount * 100 AS hba, l_tax * 1500 AS tpsa FROM lineitem),
    f AS (SELECT *, mw < 450 AS mw_ok, logp BETWEEN 1 AND 3 AS logp_ok, hbd < 3 AS hbd_ok, hba < 7 AS hba_ok, tpsa < 90 AS tpsa_ok FROM p)
    SELECT l_orderkey, mw_ok, logp_ok, hbd_ok, hba_ok, tpsa_ok,
      mw_ok::INT + logp_ok::INT + hbd_ok::INT + hba_ok::INT + tpsa_ok::INT AS rules_passed FROM f""",
)
def rule_screen(spark, d):
    li = Tables(spark, d).lineitem.select(
        "l_orderkey",
        (F.col("l_extendedprice") / 100).alias("mw"),
        (F.col("l_quantity") / 10).alias("logp"),
        F.col("l_linenumber").alias("hbd"),
        (F.col("l_discount") * 100).alias("hba"),
        (F.col("l_tax") * 1500).alias("tpsa"),
    )
    return scoring.rule_screen(li).drop("mw", "logp", "hbd", "hba", "tpsa")


_num = lambda c, k: f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.{k}f', round_even({c}, {k})) END"


@query(
    "display_table",
    f"""WITH {RESULTS} SELECT o_orderkey, input AS "Input", COALESCE(name, '') AS "Name", status AS "Status",
    COALESCE(prediction, 'N/A') AS "Prediction", {_num('confidence', 1)} AS "Confidence",
    {_num('uncertainty', 1)} AS "Uncertainty", {_num('agreement', 1)} AS "Agreement",
    {_num('molecular_weight', 1)} AS "MW", {_num('logp', 2)} AS "LogP", COALESCE(smiles, 'N/A') AS "SMILES",
    CASE WHEN status = 'Error' THEN COALESCE(error, 'Unknown error') END AS "Error" FROM results""",
)
def display_table(spark, d):
    return format_results(results(spark, d), "o_orderkey")


# Deterministic stand-ins for three fitted models: linear heads over two scaled features.
_HEADS = {"KNN": (0.31, 0.9, -0.4), "LGBM": (-0.17, -0.6, 0.8), "ET": (0.07, 0.5, 0.5)}


def _head(name: str):
    def make():
        bias, a, b = _HEADS[name]
        z = F.lit(bias) + F.col("qty") * F.lit(a) + F.col("price") * F.lit(b)
        p1 = 1 / (1 + F.exp(-z))
        return F.when(z >= 0, 1).otherwise(0), p1

    return make


_BATCH_INPUT = """part_input AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size > 45 THEN 'unknown ' || p_size
      ELSE p_brand END AS input, p_name AS name FROM part),
  known AS (SELECT p_name, min(p_brand) AS smiles FROM part WHERE p_type <> 'SMALL' GROUP BY 1),
  resolved AS (SELECT i.p_partkey, i.input, i.name, CASE WHEN regexp_full_match(i.input, 'Brand#[0-9]+') THEN i.input
      ELSE k.smiles END AS smiles FROM part_input i LEFT JOIN known k ON lower(trim(i.input)) = lower(k.p_name)),
  feats AS (SELECT p_brand, avg(l_quantity) AS qty, avg(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_quantity < 50 AND p_brand <> 'Brand#7' GROUP BY 1),
  scaled AS (SELECT r.*, (qty - 25) / 10 AS qty, (price - 50000) / 20000 AS price FROM resolved r JOIN feats f ON r.smiles = f.p_brand)"""


@query(
    "score_batch",
    f"""WITH {_BATCH_INPUT}, s AS (SELECT p_partkey, input, name, smiles, z, 1 / (1 + exp(-z)) AS p1 FROM (
      SELECT *, unnest([{', '.join(f'{b}::DOUBLE + qty * {x}::DOUBLE + price * {y}::DOUBLE' for b, x, y in _HEADS.values())}]) AS z
      FROM scaled)),
    v AS (SELECT p_partkey, input, name, smiles, avg((z >= 0)::INT) AS share, avg(p1) * 100 AS confidence,
      stddev_pop(p1) * 100 AS uncertainty, count(*) AS num_models FROM s GROUP BY ALL)
    SELECT p_partkey, input, name, smiles, 'Success' AS status, NULL AS error,
      CASE WHEN share >= 0.5 THEN 'BBB+' ELSE 'BBB-' END AS prediction, round(confidence, 5) AS confidence,
      round(uncertainty, 5) AS uncertainty, round({_fold('share * 100')}, 5) AS agreement, CAST(num_models AS DOUBLE) AS num_models FROM v
    UNION ALL SELECT p_partkey, input, name, smiles, 'Error', CASE WHEN smiles IS NULL THEN 'Could not process molecule'
      ELSE 'Descriptor calculation failed' END, NULL, NULL, NULL, NULL, NULL
    FROM resolved WHERE smiles IS NULL OR smiles NOT IN (SELECT p_brand FROM feats)""",
)
def score_batch_query(spark, d):
    t = Tables(spark, d)
    size = F.col("p_size")
    batch = t.part.select(
        "p_partkey",
        F.when(size < 10, F.col("p_name")).when(size > 45, F.concat(F.lit("unknown "), size)).otherwise(F.col("p_brand")).alias("input"),
        F.col("p_name").alias("name"),
    )
    lookup = t.part.filter(F.col("p_type") != "SMALL").select(F.col("p_name").alias("name"), F.col("p_brand").alias("smiles"))
    items = t.lineitem.filter(F.col("l_quantity") < 50).join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand").filter(F.col("p_brand") != "Brand#7"), "l_partkey"
    )
    feats = items.groupBy(F.col("p_brand").alias("smiles")).agg(
        F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price")
    )

    def describe(rows):
        made = rows.join(feats, "smiles", "left")
        return made.withColumn("failed", F.col("qty").isNull()).withColumn("qty", (F.col("qty") - 25) / 10).withColumn(
            "price", (F.col("price") - 50000) / 20000
        )

    out = score_batch(
        batch,
        "p_partkey",
        lambda b: resolve_inputs(b, lambda c: c.rlike("^Brand#[0-9]+$"), "mixed", lookup),
        describe,
        {m: _head(m) for m in _HEADS},
        ["qty", "price"],
    )
    shown = rounded(nullable(out, "num_models"), 5, "confidence", "uncertainty", "agreement")
    return order_for_display(shown, "p_partkey")


# ---- evaluation --------------------------------------------------------------------------

_CELLS = """count(*) FILTER (actual = 0 AND pred = 0) AS tn, count(*) FILTER (actual = 0 AND pred = 1) AS fp,
    count(*) FILTER (actual = 1 AND pred = 0) AS fn, count(*) FILTER (actual = 1 AND pred = 1) AS tp"""
_METRICS = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(COALESCE(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(COALESCE(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(COALESCE(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
    round(COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(COALESCE((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc"""
_METRIC_NAMES = ("accuracy", "precision", "recall", "specificity", "f1", "mcc")


def _labels(spark, d):
    return Tables(spark, d).labels.select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("pred"))


@query("confusion_matrix", f"WITH r AS (SELECT quality AS actual, 1 - toxic AS pred FROM labels) SELECT {_CELLS} FROM r")
def confusion_matrix(spark, d):
    return evaluation.confusion(_labels(spark, d))


@query(
    "classification_metrics",
    f"""WITH r AS (SELECT quality AS actual, 1 - toxic AS pred FROM labels), c AS (SELECT {_CELLS} FROM r)
    SELECT tn, fp, fn, tp, {_METRICS} FROM c""",
)
def classification_metrics(spark, d):
    return rounded(evaluation.metrics(_labels(spark, d)), 6, *_METRIC_NAMES)


_AUC = """(sum(CASE WHEN actual = 1 THEN r END) - count(*) FILTER (actual = 1) * (count(*) FILTER (actual = 1) + 1) / 2)
      / (count(*) FILTER (actual = 1) * count(*) FILTER (actual = 0))"""


def _ranks(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    peers = f"PARTITION BY {by + ', ' if by else ''}score"
    return f"""ranks AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({peers}) - 1) / 2 AS r FROM {source})"""


def _steps(source: str, by: str = "") -> str:
    key = by + ", " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""g AS (SELECT {key}score, count(*) FILTER (actual = 1) AS pos, count(*) AS n FROM {source} GROUP BY {key}score),
    st AS (SELECT {key}pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER ({part}) AS np FROM g
      WINDOW w AS ({part} ORDER BY score DESC))"""


_SCORED = "scored AS (SELECT quality AS actual, n_chars AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    t = Tables(spark, d)
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("actual"), F.col("n_chars").alias("score")
    )


@query("roc_auc", f"WITH {_SCORED}, {_ranks('scored')} SELECT round({_AUC}, 9) AS roc_auc FROM ranks")
def roc_auc(spark, d):
    return rounded(evaluation.roc_auc(_scored(spark, d)), 9, "roc_auc")


@query(
    "average_precision",
    f"WITH {_SCORED}, {_steps('scored')} SELECT round(sum(pos / np * cp / cn), 9) AS average_precision FROM st",
)
def average_precision(spark, d):
    return rounded(evaluation.average_precision(_scored(spark, d)), 9, "average_precision")


@query(
    "class_hits",
    f"""WITH {scores_sql()} SELECT actual, model, count(*) AS total, count(*) FILTER (pred = actual) AS hits,
    round(100.0 * avg((pred = actual)::INT), 6) AS hit_rate FROM scores GROUP BY 1, 2""",
)
def class_hits(spark, d):
    return rounded(evaluation.class_hits(scores(spark, d)), 6, "hit_rate")


@query(
    "leaderboard",
    f"""WITH {scores_sql(('KNN', 'LGBM', 'ET', 'XGB'))}, ok AS (SELECT *, p1 AS score FROM scores WHERE p1 IS NOT NULL),
    c AS (SELECT model, {_CELLS} FROM scores GROUP BY model), {_ranks('ok', 'model')},
    a AS (SELECT model, {_AUC} AS auc FROM ranks GROUP BY model), {_steps('ok', 'model')},
    p AS (SELECT model, sum(pos / np * cp / cn) AS ap FROM st GROUP BY model)
    SELECT c.model, {_METRICS}, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision
    FROM c JOIN a ON c.model = a.model JOIN p ON c.model = p.model""",
)
def leaderboard(spark, d):
    rows = scores(spark, d, ("KNN", "LGBM", "ET", "XGB")).withColumn("score", F.col("p1"))
    out = evaluation.leaderboard(rows)
    return rounded(rounded(out, 6, *_METRIC_NAMES), 9, "roc_auc", "average_precision")


@query(
    "cv_summary",
    f"""WITH {scores_sql()}, f AS (SELECT model, event_id % 5 AS fold, avg((pred = actual)::INT) AS acc FROM scores GROUP BY 1, 2)
    SELECT model, round(avg(acc), 6) AS mean_score, round(stddev_pop(acc), 6) AS std_score, count(*) AS n_folds FROM f GROUP BY 1""",
)
def cv_summary(spark, d):
    folds = scores(spark, d).groupBy("model", (F.col("event_id") % 5).alias("fold")).agg(
        F.avg((F.col("pred") == F.col("actual")).cast("double")).alias("acc")
    )
    return rounded(evaluation.cv_summary(folds, "model", "acc"), 6, "mean_score", "std_score")


@query(
    "best_checkpoint",
    """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (
      PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def best_checkpoint(spark, d):
    history = Tables(spark, d).events.select("user_id", "event_id", "value")
    return evaluation.best_checkpoint(history, "event_id", "value", by=["user_id"])
