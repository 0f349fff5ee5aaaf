"""Sources, projection, filters, joins, sets and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from permeon.functions.cleaning import coerce_number, first_present
from permeon.functions.labels import decode_label, encode_label, map_lookup
from permeon.operators import dedup, filters, joins, projection, sampling, sets
from permeon.plans.catalog.inputs import (
    RESULTS,
    SPARSE_EVENTS,
    SPARSE_ITEMS,
    results,
    sparse_events,
    sparse_items,
)
from permeon.operators.ordering import ranked
from permeon.plans.catalog.registry import Tables, draw_sql, nullable, query
from permeon.session import scratch_dir
from permeon.sources.columns import as_batch_input
from permeon.sources.delimited import read_delimited, write_delimited
from permeon.sources.lines import read_lines, split_lines, write_json, write_lines
from permeon.sources.multi import read_sources
from permeon.sources.store import ResultStore, append_aligned, prediction_record, process_resumable

# ---- sources and sinks -------------------------------------------------------------------


@query("delimited_scan", "SELECT * FROM part")
def delimited_scan(spark, d):
    part, path = Tables(spark, d).part, scratch_dir(spark, "csv")
    write_delimited(part, path)
    return read_delimited(spark, path, schema=part.schema)


@query(
    "line_scan",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    e AS (SELECT doc_id, parts, unnest(range(len(parts))) AS line_no FROM l),
    t AS (SELECT doc_id, line_no, regexp_replace(parts[line_no + 1], '^\s+|\s+$', '', 'g') AS input FROM e)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, input FROM t WHERE length(input) > 0""",
)
def line_scan(spark, d):
    return split_lines(Tables(spark, d).documents.select("doc_id", "text"), "text")


@query("resolve_columns", "SELECT doc_id, text AS input, lang AS name FROM documents")
def resolve(spark, d):
    docs = Tables(spark, d).documents
    return as_batch_input(docs.select("doc_id", F.col("text").alias("SMILES"), F.col("lang").alias("Name")), "doc_id")


@query(
    "multi_source_scan",
    """SELECT doc_id, text, CAST(substr(source, 4) AS INTEGER) AS source_no, 'R' || substr(source, 4) AS reference
    FROM documents""",
)
def multi_source_scan(spark, d):
    docs, root = Tables(spark, d).documents, scratch_dir(spark, "sources")
    folder = F.concat(F.lit("R"), F.substring("source", 4, 10)).alias("folder")
    docs.select("doc_id", "text", folder).write.partitionBy("folder").json(root)
    return read_sources(spark, f"{root}/folder=*", docs.select("doc_id", "text").schema)


@query("tsv_round_trip", "SELECT * FROM supplier")
def tsv_round_trip(spark, d):
    supplier, path = Tables(spark, d).supplier, scratch_dir(spark, "tsv")
    write_delimited(supplier, path, sep="\t", compression="gzip")
    return read_delimited(spark, path, sep="\t", schema=supplier.schema, partitions=2)


@query("line_sink", "SELECT p_name || chr(9) || p_partkey AS input FROM part")
def line_sink(spark, d):
    path = scratch_dir(spark, "lines")
    write_lines(Tables(spark, d).part, ["p_name", "p_partkey"], path)
    return read_lines(spark, path)


@query("json_export", "SELECT doc_id, quality, toxic FROM labels")
def json_export(spark, d):
    labels, path = Tables(spark, d).labels, scratch_dir(spark, "json")
    write_json(labels, path)
    return spark.read.schema(labels.schema).json(path)


@query(
    "insert_if_absent",
    """WITH target AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name,
      CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS prediction, s_acctbal AS confidence FROM supplier),
    batch AS (SELECT CAST(o_custkey AS VARCHAR) AS key,
      COALESCE(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, CAST(o_custkey AS VARCHAR)) AS name,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS prediction, o_totalprice AS confidence,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
    SELECT key, name, prediction, confidence FROM target
    UNION ALL SELECT key, name, prediction, confidence FROM batch
    WHERE rn = 1 AND key NOT IN (SELECT key FROM target)""",
)
def insert_query(spark, d):
    t = Tables(spark, d)
    start = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("key"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("prediction"),
        F.col("s_acctbal").alias("confidence"),
    )
    batch = t.orders.select(
        *prediction_record(
            F.col("o_custkey").cast("string"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
            F.when(F.col("o_orderstatus") == "F", "BBB+").otherwise("BBB-"),
        ),
        F.col("o_totalprice").alias("confidence"),
        "o_orderkey",
    )
    store = ResultStore(spark, scratch_dir(spark, "store"), start.schema, "key", buckets=8)
    store.insert(start, ["name"])
    store.insert(batch, ["o_orderkey"])
    store.insert(batch, ["o_orderkey"])
    return store.read()


@query(
    "append_aligned",
    """SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier
    UNION ALL SELECT c_custkey, c_name, NULL, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def append_query(spark, d):
    t = Tables(spark, d)
    target = projection.project(
        t.supplier, {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}
    )
    new = projection.project(
        t.customer, {"c_custkey": "key", "c_mktsegment": "segment", "c_acctbal": "balance", "c_name": "name"}
    )
    return nullable(append_aligned(target, new, "key"), "nation")


@query(
    "process_resumable",
    """SELECT o_orderkey, o_totalprice * 2 AS result FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderpriority <> '5-LOW'""",
)
def resumable(spark, d):
    t = Tables(spark, d)

    def work(df):
        return df.select(
            "o_orderkey",
            (F.col("o_totalprice") * 2).alias("result"),
            (F.col("o_orderpriority") == "5-LOW").alias("failed"),
        )

    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return process_resumable(t.orders, done, "o_orderkey", work, "failed")


# ---- projection, nulls, filters ----------------------------------------------------------


@query("project", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS weight FROM part")
def project_query(spark, d):
    return projection.project(Tables(spark, d).part, {"p_partkey": "id", "p_name": "name", "p_retailprice": "weight"})


@query("feature_block", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_block(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", *projection.feature_columns(li, "l_quantity"))


@query("label_encode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders")
def label_encode(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", encode_label("o_orderstatus", "F").alias("label"))


@query(
    "label_decode",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'BBB+' ELSE 'BBB-' END AS quality,
    CASE WHEN toxic = 1 THEN 'BBB+' ELSE 'BBB-' END AS toxic FROM labels""",
)
def label_decode(spark, d):
    return projection.for_columns(Tables(spark, d).labels, ["quality", "toxic"], decode_label)


@query(
    "drop_null_rows",
    f"""WITH {SPARSE_EVENTS} SELECT * FROM sparse
    WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)""",
)
def drop_null_rows(spark, d):
    return filters.drop_null(sparse_events(spark, d))


@query(
    "drop_sparse_rows",
    f"""WITH {SPARSE_EVENTS} SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, event_type,
    CASE WHEN NOT isnan(value) THEN value END AS value FROM sparse
    WHERE (user_id IS NOT NULL)::INT + (event_type IS NOT NULL)::INT
        + (value IS NOT NULL AND NOT isnan(value))::INT >= 2""",
)
def drop_sparse(spark, d):
    kept = filters.drop_sparse_rows(sparse_events(spark, d), ["user_id", "event_type", "value"], 0.5)
    return nullable(kept, "user_id").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


@query(
    "range_filter",
    """SELECT c_custkey, balance FROM (SELECT c_custkey,
      CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer)
    WHERE balance IS NULL OR (balance > -9 AND balance <= 9000)""",
)
def range_filter(spark, d):
    c = Tables(spark, d).customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance")
    )
    return filters.filter_range(c, "balance", -9, 9000, lo_inclusive=False, keep_null=True)


@query(
    "facet_filter",
    f"""WITH {RESULTS} SELECT o_orderkey, status, prediction FROM results
    WHERE status IN ('Success', 'Error') AND (prediction IN ('BBB+') OR prediction IS NULL)""",
)
def facet(spark, d):
    wanted = {"status": ["Success", "Error"], "prediction": ["BBB+"]}
    return filters.facet_filter(results(spark, d), wanted, keep_null=["prediction"]).select(
        "o_orderkey", "status", "prediction"
    )


@query(
    "property_search",
    f"""WITH {RESULTS} SELECT o_orderkey, molecular_weight, logp, confidence FROM results
    WHERE molecular_weight BETWEEN 100 AND 450 AND logp BETWEEN 1 AND 3 AND prediction = 'BBB+' AND confidence >= 60""",
)
def search(spark, d):
    hits = filters.property_search(
        results(spark, d),
        {"molecular_weight": (100, 450), "logp": (1, 3)},
        ("prediction", "BBB+"),
        ("confidence", 60.0),
    )
    return hits.select("o_orderkey", "molecular_weight", "logp", "confidence")


@query(
    "prune_columns",
    f"""WITH {SPARSE_ITEMS} SELECT l_orderkey, CASE WHEN isfinite(qty) THEN qty END AS qty FROM sparse""",
)
def prune(spark, d):
    items = sparse_items(spark, d).drop("price")
    kept = projection.prune_columns(items, ["qty", "tax", "empty"], max_nulls=None, max_share=0.5)
    finite = [F.when(F.abs(c) != float("inf"), F.col(c)).alias(c) for c in kept]
    return items.select("l_orderkey", *finite)


@query(
    "align_features",
    """SELECT l_orderkey, l_tax, l_discount, l_quantity, l_extendedprice, l_linenumber, l_partkey, l_suppkey,
    l_returnflag, l_linestatus, CAST(0 AS DOUBLE) AS l_volume FROM lineitem""",
)
def align(spark, d):
    expected = [
        "l_tax", "l_discount", "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey",
        "l_returnflag", "l_linestatus", "l_volume",
    ]
    return projection.align_features(Tables(spark, d).lineitem, expected, keep=["l_orderkey"])


@query(
    "numeric_coerce",
    """SELECT p_partkey, COALESCE(TRY_CAST(substr(p_brand, 7) AS DOUBLE), 0) AS brand_no,
    COALESCE(TRY_CAST(p_name AS DOUBLE), 0) AS name_no FROM part""",
)
def coerce(spark, d):
    return Tables(spark, d).part.select(
        "p_partkey",
        coerce_number(F.substring("p_brand", 7, 10)).alias("brand_no"),
        coerce_number("p_name").alias("name_no"),
    )


@query(
    "synthetic_id",
    """SELECT p_partkey, 'Mol_' || (row_number() OVER (ORDER BY p_partkey) - 1) || '_'
      || COALESCE(CASE WHEN p_size >= 5 THEN p_name END, 'Unknown') AS unique_id FROM part""",
)
def synthetic_id(spark, d):
    part = Tables(spark, d).part.select("p_partkey", F.when(F.col("p_size") >= 5, F.col("p_name")).alias("p_name"))
    return projection.make_id(part, "p_partkey", "p_name").select("p_partkey", "unique_id")


@query(
    "first_present",
    """SELECT event_id, COALESCE(CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END, props) AS key
    FROM events""",
)
def first_present_query(spark, d):
    iso = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    return Tables(spark, d).events.select("event_id", first_present(iso, "props").alias("key"))


@query("sample_rows", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {draw_sql(42, 'o_orderkey')} LIMIT 500")
def sample_rows(spark, d):
    return sampling.sample_n(Tables(spark, d).orders, "o_orderkey", 500).select("o_orderkey", "o_custkey")


@query("drop_blank", "SELECT doc_id, lang FROM documents WHERE lang <> 'de'")
def drop_blank(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", F.when(F.col("lang") == "de", " \t").otherwise(F.col("lang")).alias("lang"))
    return filters.drop_blank(docs, "lang")


# ---- joins -------------------------------------------------------------------------------


@query(
    "left_join",
    """SELECT d.doc_id, n_chars, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def left_join(spark, d):
    t = Tables(spark, d)
    joined = joins.join_features(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "left")
    return nullable(joined, "quality", "toxic")


@query(
    "inner_join",
    """SELECT c_custkey, o_orderkey, c_acctbal, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def inner_join(spark, d):
    t = Tables(spark, d)
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.join_features(orders, t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "inner")


@query(
    "first_match_lookup",
    """WITH f AS (SELECT l_partkey, l_quantity, row_number() OVER (
      PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem)
    SELECT p_partkey, p_name, l_quantity FROM part LEFT JOIN f ON p_partkey = l_partkey AND rn = 1""",
)
def first_match(spark, d):
    t = Tables(spark, d)
    return joins.lookup_first(
        t.part.select("p_partkey", "p_name"), t.lineitem, "p_partkey", "l_quantity",
        ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], right_key="l_partkey",
    )


@query(
    "anti_join",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def anti_join(spark, d):
    t = Tables(spark, d)
    return joins.new_rows(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query(
    "positional_join",
    """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_pos FROM part),
    b AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT row_pos, p_partkey, o_orderstatus, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM a LEFT JOIN b ON pos - 3001 = row_pos AND pos >= 3001 AND pos < 6001""",
)
def positional_join(spark, d):
    t = Tables(spark, d)
    zipped = joins.zip_join(
        t.part.select("p_partkey"), t.orders, "p_partkey", "o_orderkey", 3001, 6001, ["o_orderstatus", "o_orderkey"], "left"
    )
    return nullable(zipped, "o_orderkey")


@query(
    "horizontal_concat",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_pos FROM customer),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_pos FROM part)
    SELECT row_pos, CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(p_partkey AS DOUBLE) AS p_partkey FROM a FULL JOIN b USING (row_pos)""",
)
def horizontal_concat(spark, d):
    t = Tables(spark, d)
    both = joins.hconcat(t.customer.select("c_custkey"), t.part.select("p_partkey"), "c_custkey", "p_partkey")
    return nullable(both, "c_custkey", "p_partkey")


@query(
    "dictionary_lookup",
    """SELECT s_suppkey, CASE s_nationkey WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 5 THEN 'east' END AS zone
    FROM supplier""",
)
def dictionary_lookup(spark, d):
    zones = {0: "north", 1: "south", 5: "east"}
    return Tables(spark, d).supplier.select("s_suppkey", map_lookup("s_nationkey", zones).alias("zone"))


@query(
    "identifier_enrichment",
    """WITH c AS (SELECT lower(p_name) AS k, arg_min(p_partkey, p_partkey) AS first_id,
      lower(arg_min(p_type, p_partkey)) AS syn, count(*) AS n FROM part GROUP BY 1),
    q AS (SELECT p_partkey, lower(p_name) AS k, CASE WHEN p_size > 40 THEN p_partkey END AS cid FROM part)
    SELECT p_partkey, COALESCE(cid, first_id) AS cid,
      CASE WHEN cid IS NULL AND n >= 2 AND syn <> 'economy' THEN 'More than one CID available for ' || q.k END AS comments
    FROM q LEFT JOIN c ON q.k = c.k""",
)
def enrichment(spark, d):
    part = Tables(spark, d).part
    rows = part.select(
        "p_partkey", F.upper("p_name").alias("name"), F.when(F.col("p_size") > 40, F.col("p_partkey")).alias("cid")
    )
    own = F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).otherwise(F.col("p_type"))
    lookup = part.select(F.col("p_name").alias("known_as"), F.col("p_partkey").alias("id"), F.array(own).alias("synonyms"))
    out = joins.enrich_identifier(rows, lookup, "name", "known_as", "id", ["id"], "synonyms")
    return out.select("p_partkey", "cid", "comments")


# ---- sets --------------------------------------------------------------------------------


@query(
    "union_sources",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def union_query(spark, d):
    t = Tables(spark, d)
    a = projection.project(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"})
    b = projection.project(t.supplier, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})
    return sets.union_sources(a, b)


@query(
    "schema_report",
    """WITH n AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS a, (SELECT count(*) FROM labels)::DOUBLE AS b)
    SELECT 'doc_id' AS "column", 'both' AS side, a AS filled_a, b AS filled_b FROM n
    UNION ALL SELECT 'text', 'only_a', a, NULL FROM n UNION ALL SELECT 'lang', 'only_a', a, NULL FROM n
    UNION ALL SELECT 'source', 'only_a', a, NULL FROM n UNION ALL SELECT 'n_chars', 'only_a', a, NULL FROM n
    UNION ALL SELECT 'quality', 'only_b', NULL, b FROM n UNION ALL SELECT 'toxic', 'only_b', NULL, b FROM n""",
)
def schema_report(spark, d):
    t = Tables(spark, d)
    return nullable(sets.schema_report(t.documents, t.labels), "filled_a", "filled_b")


@query("distinct_values", "SELECT DISTINCT user_id FROM events")
def distinct_query(spark, d):
    return sets.distinct_values(Tables(spark, d).events, "user_id")


@query("count_distinct", "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type FROM events")
def count_distinct_query(spark, d):
    return sets.count_distinct(Tables(spark, d).events, ["user_id", "event_type"])


# ---- dedup, order, top-k -----------------------------------------------------------------


@query(
    "dedup_keep_first",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events) WHERE rn = 1""",
)
def dedup_keep_first(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "event_type", "value")
    return dedup.dedup_first(e, ["user_id"], ["value", "event_id"])


@query(
    "dedup_drop_all",
    """SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey, min(l_quantity) AS l_quantity FROM lineitem
    GROUP BY l_partkey, l_suppkey HAVING count(*) = 1""",
)
def dedup_drop_all(spark, d):
    li = Tables(spark, d).lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")
    return dedup.dedup_none(li, ["l_partkey", "l_suppkey"])


@query("duplicate_count", "SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark, d):
    return dedup.count_duplicates(Tables(spark, d).documents, ["text"], digest=True)


@query("multi_key_sort", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY 1, 2 DESC, 3")
def multi_key_sort(spark, d):
    o = Tables(spark, d).orders.select("o_orderstatus", "o_totalprice", "o_orderkey")
    return dedup.order_rows(o, ["o_orderstatus", "o_totalprice", "o_orderkey"], [True, False, True])


@query("natural_sort", "SELECT p_brand, p_partkey FROM part ORDER BY CAST(substr(p_brand, 7) AS BIGINT), p_brand")
def natural_sort(spark, d):
    return dedup.natural_sort(Tables(spark, d).part.select("p_brand", "p_partkey"), "p_brand", r"#(\d+)$")


@query(
    "slice_rows",
    """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey,
      row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 100 AND pos < 1100""",
)
def slice_query(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return dedup.slice_rows(o, ["o_totalprice", "o_orderkey"], 100, 1100).drop("o_totalprice")


@query("top_k", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_k_query(spark, d):
    return dedup.top_k(Tables(spark, d).part.select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", 20, ["p_partkey"])


@query(
    "best_row",
    """SELECT o_orderpriority, avg_price FROM (SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price
    FROM orders GROUP BY 1) ORDER BY avg_price DESC, o_orderpriority LIMIT 1""",
)
def best_row(spark, d):
    board = Tables(spark, d).orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    return dedup.best_by(board, "avg_price", "o_orderpriority")


# ---- positions by keys of other types -----------------------------------------------------


@query(
    "rank_by_text",
    "SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC NULLS LAST, p_partkey) - 1 AS pos FROM part",
)
def rank_by_text(spark, d):
    return ranked(Tables(spark, d).part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], name="pos", ascending=[False, True]).drop("p_name")


@query(
    "rank_by_decimal",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
      ORDER BY l_extendedprice::DECIMAL(15, 2), l_orderkey, l_linenumber) - 1 AS pos FROM lineitem""",
)
def rank_by_decimal(spark, d):
    price = F.col("l_extendedprice").cast("decimal(15,2)").alias("price")
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", price)
    placed = ranked(rows, ["price", "l_orderkey", "l_linenumber"], by=["l_returnflag"], name="pos", hot_rows=1000)
    return placed.select("l_orderkey", "l_linenumber", "pos")


@query(
    "rank_by_large_id",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders",
)
def rank_by_large_id(spark, d):
    key = (F.lit(1 << 60) + F.col("o_orderkey")).alias("big")
    return ranked(Tables(spark, d).orders.select("o_orderkey", key), "big", name="pos").drop("big")
