"""Feature preparation, splits, balancing and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from permeon.operators import distribution, features, neighbors, sampling
from permeon.plans.catalog.analysis import rounded
from permeon.plans.catalog.inputs import SPARSE_ITEMS, sparse_items
from permeon.plans.catalog.registry import Tables, draw_sql, query

_finite = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"


@query(
    "sanitize",
    f"""WITH {SPARSE_ITEMS}, c AS (SELECT l_orderkey, l_partkey, {_finite('qty')} AS qty, {_finite('price')} AS price,
      {_finite('tax')} AS tax FROM sparse),
    m AS (SELECT quantile_cont(qty, 0.5) AS q, quantile_cont(price, 0.5) AS p, quantile_cont(tax, 0.5) AS t FROM c)
    SELECT l_orderkey, l_partkey, round(COALESCE(qty, q), 6) AS qty, round(COALESCE(price, p), 6) AS price,
      round(COALESCE(tax, t), 6) AS tax, CAST(0 AS DOUBLE) AS empty FROM c, m""",
)
def sanitize(spark, d):
    return rounded(features.sanitize(sparse_items(spark, d), ["qty", "price", "tax", "empty"]), 6, "qty", "price", "tax")


@query(
    "constant_impute",
    f"""WITH {SPARSE_ITEMS} SELECT l_orderkey,
    CASE WHEN qty IS NULL OR isnan(qty) THEN 0 WHEN isinf(qty) THEN sign(qty) * 1e6 ELSE qty END AS qty,
    CASE WHEN price IS NULL OR isnan(price) THEN 0 WHEN isinf(price) THEN sign(price) * 1e6 ELSE price END AS price
    FROM sparse""",
)
def constant_impute(spark, d):
    return features.impute_const(
        sparse_items(spark, d).select("l_orderkey", "qty", "price"), ["qty", "price"], 0.0, 1e6, -1e6
    )


@query(
    "hard_clip",
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN greatest(least(c_acctbal, 5000), 0) END AS balance
    FROM customer""",
)
def hard_clip(spark, d):
    c = Tables(spark, d).customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance")
    )
    return features.hard_clip(c, ["balance"], 0.0, 5000.0)


@query(
    "winsorize",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi,
      quantile_cont(l_quantity, 0.001) AS ql, quantile_cont(l_quantity, 0.999) AS qh FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo), 6) AS l_extendedprice,
      greatest(least(l_quantity, qh), ql) AS l_quantity FROM lineitem, q""",
)
def winsorize(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(features.winsorize(li, ["l_extendedprice", "l_quantity"]), 6, "l_extendedprice")


@query("variance_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def variance_filter(spark, d):
    li = Tables(spark, d).lineitem
    kept = features.variance_filter(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return li.select("l_orderkey", "l_linenumber", *kept)


@query(
    "standardise",
    """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) AS l_quantity, round((l_tax - tm) / ts, 6) AS l_tax,
      CAST(0 AS DOUBLE) AS flat FROM lineitem, s""",
)
def standardise(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(7.0).alias("flat"))
    scaler = features.fit_scaler(li, ["l_quantity", "l_tax", "flat"])
    return rounded(features.apply_scaler(li, scaler), 6, "l_quantity", "l_tax")


@query(
    "standardise_array",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i)
    SELECT vec_id, CAST(x.i AS INTEGER) AS i, round((x - m) / s, 5) AS x FROM x JOIN s ON x.i = s.i""",
)
def standardise_array(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    scaled = features.apply_array_scaler(e, "embedding", features.fit_array_scaler(e, "embedding"))
    return scaled.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x")
    )


@query("pca_projection")
def pca_projection(spark, d):
    return features.pca(Tables(spark, d).embeddings, "embedding", 2).rows


# ---- samples, splits, folds --------------------------------------------------------------


def _split_sql(table: str, key: str, label: str | None, cut: str, columns: str) -> str:
    part = f"PARTITION BY {label}" if label else ""
    return (
        f"WITH p AS (SELECT *, row_number() OVER ({part} ORDER BY {draw_sql(42, key)}, {key}) - 1 AS pos, "
        f"count(*) OVER ({part}) AS n FROM {table}) SELECT {columns}, {cut} FROM p"
    )


@query(
    "stratified_split",
    _split_sql("embeddings", "vec_id", "label", "CASE WHEN pos < round(n * 0.2) THEN 'test' ELSE 'train' END AS split", "vec_id, label"),
)
def stratified_split(spark, d):
    return sampling.stratified_split(Tables(spark, d).embeddings.select("vec_id", "label"), "vec_id", "label")


@query(
    "plain_split",
    _split_sql("orders", "o_orderkey", None, "CASE WHEN pos < round(n * 0.2) THEN 'test' ELSE 'train' END AS split", "o_orderkey"),
)
def plain_split(spark, d):
    return sampling.plain_split(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey")


@query(
    "three_way_split",
    _split_sql(
        "orders", "o_orderkey", None,
        "CASE WHEN pos < round(n * 0.1) THEN 'valid' WHEN pos < 2 * round(n * 0.1) THEN 'test' ELSE 'train' END AS split",
        "o_orderkey",
    ),
)
def three_way_split(spark, d):
    return sampling.three_way_split(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey")


@query("stratified_folds", _split_sql("labels", "doc_id", "quality", "CAST(pos % 5 AS INTEGER) AS fold", "doc_id, quality"))
def stratified_folds(spark, d):
    return sampling.stratified_folds(Tables(spark, d).labels.select("doc_id", "quality"), "doc_id", "quality")


# ---- neighbours and balancing ------------------------------------------------------------

_SPLIT_VECTORS = f"""p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x,
    row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'vec_id')}, vec_id) - 1 AS pos,
    count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  test AS (SELECT * FROM p WHERE pos < round(n * 0.2)), train AS (SELECT * FROM p WHERE pos >= round(n * 0.2))"""


def _split_vectors(spark, d):
    parts = sampling.stratified_split(Tables(spark, d).embeddings, "vec_id", "label")
    return parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")


_NEAR = """near AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label, list_distance(a.x, b.x) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
    FROM test a CROSS JOIN train b QUALIFY rank <= 5)"""


@query(
    "nearest_neighbors",
    f"""WITH {_SPLIT_VECTORS}, {_NEAR} SELECT query_id, neighbor_id, round(distance, 6) AS distance,
    CAST(rank AS INTEGER) AS rank FROM near""",
)
def nearest(spark, d):
    train, test = _split_vectors(spark, d)
    return rounded(neighbors.nearest_neighbors(train, test, "vec_id", "embedding", 5), 6, "distance")


@query(
    "knn_classify",
    f"""WITH {_SPLIT_VECTORS}, {_NEAR},
    w AS (SELECT query_id, label, sum(1 / distance) AS w FROM near GROUP BY 1, 2)
    SELECT query_id, arg_min(label, (-round(w, 9), label)) AS pred,
      round(COALESCE(sum(w) FILTER (label = 1), 0) / sum(w), 6) AS p1 FROM w GROUP BY 1""",
)
def knn_classify(spark, d):
    train, test = _split_vectors(spark, d)
    out = neighbors.knn_classify(train, test, "vec_id", "embedding", "label", 5, weights="distance")
    return rounded(out, 6, "p1")


def _binary(spark, d):
    return Tables(spark, d).embeddings.select("vec_id", "embedding", F.when(F.col("label") >= 7, 1).otherwise(0).alias("y"))


@query(
    "smote",
    f"""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY {draw_sql(42, "'place'", 'vec_id')}, vec_id) - 1 AS place
      FROM embeddings WHERE label >= 7),
    c AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM embeddings WHERE label < 7) AS big),
    near AS (SELECT a.vec_id AS base, b.vec_id AS neighbor, row_number() OVER (
        PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS pick
      FROM m a JOIN m b ON a.vec_id <> b.vec_id QUALIFY pick <= 5),
    w AS (SELECT i, ({draw_sql(42, "'1-base'", 'i')}) % n AS place, ({draw_sql(42, "'1-pick'", 'i')}) % 5 + 1 AS pick,
        ({draw_sql(42, "'1-u'", 'i')})::DOUBLE / 1152921504606846976::DOUBLE AS u
      FROM c, (SELECT unnest(range((SELECT big - n FROM c))) AS i))
    SELECT 1 AS y, w.i, near.base, near.neighbor, round(u, 9) AS u,
      e.dim, round(a.x[e.dim] + u * (b.x[e.dim] - a.x[e.dim]), 6) AS x
    FROM (SELECT unnest(range(1, 65)) AS dim) e, w JOIN m a ON a.place = w.place JOIN near ON near.base = a.vec_id AND near.pick = w.pick
    JOIN m b ON b.vec_id = near.neighbor""",
)
def smote(spark, d):
    made = sampling.smote(_binary(spark, d), "vec_id", "embedding", "y")
    made = made.select("y", "i", "base", "neighbor", F.round("u", 9).alias("u"), F.posexplode("embedding").alias("dim", "x"))
    return made.withColumns({"dim": (F.col("dim") + 1).cast("bigint"), "x": F.round("x", 6)})


@query(
    "balance_report",
    """WITH c AS (SELECT CASE WHEN label >= 7 THEN 1 ELSE 0 END AS y, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT y, n AS n_before, (SELECT max(n) FROM c) AS n_after FROM c""",
)
def balance_report(spark, d):
    before = _binary(spark, d)
    return distribution.balance_report(before, sampling.balanced(before, "vec_id", "embedding", "y"), "y")
