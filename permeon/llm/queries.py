"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeon.llm.common import remainder, table
from permeon.llm.decontamination import find_contamination, is_contaminated
from permeon.llm.importance import resample
from permeon.llm.language_id import fit_language_model, identify_language
from permeon.llm.license_scan import license_templates, scan_licenses
from permeon.llm.merkle import build_manifest, lowered_text, verify
from permeon.llm.packing import pack
from permeon.llm.quality_rules import BASE, judge_quality
from permeon.llm.relative_lz import remove_duplicate_windows
from permeon.llm.sharding import assign_shards
from permeon.llm.simhash import near_duplicates
from permeon.llm.suffix_dedup import removal_report
from permeon.llm.toxicity import fit_toxicity, labelled_texts, score_toxicity
from permeon.llm.url_filter import Rule, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Fixed values of the URL lists.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


@_query("op2_url_filter")
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = filter_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@_query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = assign_shards(table(spark, folder, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents")).select("doc_id", *BASE, "base_failed", "kept", "posterior")


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit_language_model(docs.where(~F.col("held_out")))
    return identify_language(docs, model, ["doc_id", "held_out"])


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = fit_toxicity(labelled_texts(docs.where(~F.col("held_out")), table(spark, folder, "labels").where(remainder("doc_id", 3) != 1)))
    scored = score_toxicity(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@_query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), 2048, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@_query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def _words_sql(relation: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {relation}"


OP6_SQL = f"""
WITH item AS ({_words_sql('benchmark', 'item_id')}), doc AS ({_words_sql('documents', 'doc_id')}),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM doc, sizes WHERE len(w) >= k)
),
hit AS (SELECT DISTINCT p.doc_id, p.i, p.k, win.item_id FROM place p JOIN win ON p.k = win.k AND p.t = win.t),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@_query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@_query("op4_license_scan")
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"), license_templates(spark))
    return found.select("doc_id", F.size("matches").alias("n_licenses"), F.concat_ws(",", "matches.license_id").alias("licenses"), F.array_max("matches.containment").alias("containment"))


@_query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removal_report(table(spark, folder, "documents"))


@_query("op11_substring_dedup")
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_duplicate_windows(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: crc32 of a list of byte values, as DuckDB has none; the polynomial is a fixed value.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""
_DIGITS_SQL = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF_SQL.format(text='text')} AS leaf,
    CASE WHEN {_CRC_SQL.format(bytes=_DIGITS_SQL)} % 3 = 0
      THEN {_LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_LEAF_SQL.format(text='text')} END AS new
  FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM d),
node AS (
  SELECT 0 AS level, lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM node WHERE n > 1 GROUP BY level, lang, pos // 8
),
sub AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM node WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, pos // 8
),
root AS (SELECT level AS height, h AS root FROM high WHERE n = 1),
run AS (
  SELECT coalesce(lang, '') || (lang IS NULL)::VARCHAR AS tree, level, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM node WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', level, pos // 8, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL
),
fold AS (
  SELECT doc_id, leaf, subroot, root, coalesce(p.lang, '') || (p.lang IS NULL)::VARCHAR AS tree, p.pos AS place, sub.pos AS above,
    sub.height AS low, sub.height + root.height AS total, 0 AS step, new AS h, '' AS proof
  FROM placed p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang, root
  UNION ALL
  SELECT doc_id, leaf, subroot, root, f.tree, CASE WHEN step + 1 = low THEN above ELSE place // 8 END, above, low, total, step + 1,
    sha256(array_to_string(hs[1 : place % 8] || [h] || hs[place % 8 + 2 :], '')), proof || array_to_string(hs[1 : place % 8] || hs[place % 8 + 2 :], '')
  FROM (SELECT * REPLACE (CASE WHEN step = 0 AND low = 0 THEN above ELSE place END AS place) FROM fold WHERE step < total) f
  JOIN run ON run.tree = CASE WHEN step < low THEN f.tree ELSE '' END AND run.level = CASE WHEN step < low THEN step ELSE step - low END AND run.parent = f.place // 8
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fold WHERE step = total
"""


@_query("op12_merkle", OP12_SQL)
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return verify(build_manifest(docs, lowered_text(remainder("doc_id", 3) == 0)))


_BYTES_SQL = "list_transform(range(0, strlen(w)), lambda i: ('0x' || hex(w)[2 * i + 1 : 2 * i + 2])::BIGINT)"
_H_SQL = "(('0x' || sha256('2024:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5)"

OP13_SQL = f"""
WITH doc AS ({_words_sql('documents', 'doc_id')}), item AS ({_words_sql('benchmark', 'item_id')}),
d AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM doc) GROUP BY w),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM item) GROUP BY w),
code AS (SELECT w, {_CRC_SQL.format(bytes=_BYTES_SQL)} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b)),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM d JOIN code USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM b JOIN code USING (w) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
gain AS (
  SELECT w, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM code LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total
),
weighed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS w FROM doc) JOIN gain USING (w) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln({_H_SQL} / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN weighed USING (doc_id)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@_query("op13_importance_resampling", OP13_SQL)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
