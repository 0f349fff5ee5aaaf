"""Text, payload and key operators, and the user-function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from permeon.functions import payload, text
from permeon.functions.labels import decode_label
from permeon.operators import features, udfs
from permeon.operators.projection import for_columns
from permeon.plans.catalog.analysis import rounded
from permeon.plans.catalog.registry import Tables, query
from permeon.session import spread
from permeon.plans.display import chat_export, pending_question

_PATTERNS = [p.replace("'", "''") for p in text.BOILERPLATE_PATTERNS]


def _cleaned(col: str) -> str:
    out = rf"regexp_replace(regexp_replace({col}, '\s+', ' ', 'g'), '\.{{2,}}', '.', 'g')"
    for p in _PATTERNS:
        out = f"regexp_replace({out}, '{p}', '', 'gi')"
    return out


@query(
    "clean_text",
    rf"""WITH c AS (SELECT doc_id, {_cleaned("text || ' Conclusions: abstract 250 words) ok.. tail'")} AS t FROM documents),
    s AS (SELECT doc_id, t, string_split(t, '.') AS parts FROM c)
    SELECT doc_id, trim(CASE WHEN len(parts) > 1 AND length(trim(parts[len(parts)])) < 10
      THEN array_to_string(parts[1:len(parts) - 1], '.') || '.' ELSE t END) AS cleaned FROM s""",
)
def clean_text(spark, d):
    raw = F.concat("text", F.lit(" Conclusions: abstract 250 words) ok.. tail"))
    docs = spread(Tables(spark, d).documents.select("doc_id", "text"))
    return docs.select("doc_id", text.clean_text(raw).alias("cleaned"))


@query(
    "complete_sentence",
    r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*[.!?])', 1) AS upto,
      regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)
    SELECT doc_id, CASE WHEN s = '' THEN text WHEN upto <> '' THEN regexp_replace(upto, '^\s+|\s+$', '', 'g') ELSE s || '.' END AS sentence
    FROM t""",
)
def complete_sentence(spark, d):
    return Tables(spark, d).documents.select("doc_id", text.complete_sentence("text").alias("sentence"))


@query(
    "prompt_template",
    """SELECT p_partkey, 'Compound: ' || p_name || '. Prediction: ' || CASE WHEN p_size > 25 THEN 'BBB+' ELSE 'BBB-' END || ' ('
      || printf('%.1f', round_even(p_size * 1.25, 1)) || '%). MW ' || printf('%.1f', round_even(p_retailprice, 1)) || ', LogP '
      || printf('%.2f', round_even(p_size / 8, 2)) || '.' AS context,
      'Explain in simple terms how ' || p_name || ' interacts with the blood-brain barrier:' AS prompt FROM part""",
)
def prompt_template(spark, d):
    size = F.col("p_size").cast("double")
    label = decode_label(F.when(F.col("p_size") > 25, 1).otherwise(0))
    return Tables(spark, d).part.select(
        "p_partkey",
        text.context_line(F.col("p_name"), label, size * 1.25, F.col("p_retailprice"), size / 8).alias("context"),
        text.render(text.PROMPT_TEMPLATES["Simple Explanation"], {"compound": F.col("p_name")}).alias("prompt"),
    )


_PROMPT = text.LINK_PROMPT.split("{name}")


@query(
    "encoded_link",
    f"""SELECT doc_id, '{text.LINK_PREFIX}' || replace(url_encode('{_PROMPT[0]}' || text || '{_PROMPT[1]}'), '%2F', '/') AS link
    FROM documents""",
)
def encoded_link(spark, d):
    return Tables(spark, d).documents.select("doc_id", text.link("text").alias("link"))


_PAYLOAD = """p AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN '{"molecules": []}' ELSE
    '{"molecules": [{"molecule_chembl_id": "C' || user_id || '", "pref_name": ' ||
    CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ', "molecule_structures": ' ||
    CASE WHEN event_type = 'click' THEN 'null' ELSE '{"canonical_smiles": "K' || json_extract_string(props, '$.k') || '"}' END
    || '}]}' END AS payload FROM events)"""


@query(
    "payload_projection",
    f"""WITH {_PAYLOAD} SELECT event_id, json_extract_string(payload, '$.molecules[0].molecule_chembl_id') AS hit_id,
    CASE WHEN event_type <> 'error' THEN COALESCE(json_extract_string(payload, '$.molecules[0].pref_name'), 'input-' || event_id) END AS name,
    json_extract_string(payload, '$.molecules[0].molecule_structures.canonical_smiles') AS smiles FROM p""",
)
def payload_projection(spark, d):
    e = Tables(spark, d).events
    kind = F.col("event_type")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pref = F.when(kind == "view", F.lit("null")).otherwise(quoted(kind))
    key = F.concat(F.lit('{"canonical_smiles": "K'), payload.json_field("props", "$.k"), F.lit('"}'))
    body = F.concat(
        F.lit('{"molecules": [{"molecule_chembl_id": "C'), F.col("user_id"), F.lit('", "pref_name": '), pref,
        F.lit(', "molecule_structures": '), F.when(kind == "click", F.lit("null")).otherwise(key), F.lit("}]}"),
    )
    raw = F.when(kind == "error", F.lit('{"molecules": []}')).otherwise(body)
    hit = payload.project_payload(raw, F.concat(F.lit("input-"), F.col("event_id")))
    return e.select("event_id", hit.alias("h")).select("event_id", "h.hit_id", "h.name", "h.smiles")


@query(
    "property_cells",
    """SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    'https://example.org/' || user_id AS first_url FROM events""",
)
def property_cells(spark, d):
    e = Tables(spark, d).events
    cell = F.concat(F.lit("TYPE = "), F.col("event_type"), F.lit(" | K = "), payload.json_field("props", "$.k"))
    refs = F.concat(
        F.lit("{'PubMed': [{'ref_id': '"), F.col("user_id"), F.lit("', 'ref_url': 'https://example.org/"), F.col("user_id"), F.lit("'}]}")
    )
    props, links = payload.property_cell(cell), payload.reference_cell(refs)
    return e.select(
        "event_id",
        props["TYPE"].alias("kind"),
        props["K"].try_cast("int").alias("k"),
        links["PubMed"][0]["ref_url"].alias("first_url"),
    )


@query(
    "chat_export",
    """SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) AS "Role", text AS "Message",
    'Conversation ' || conv_id AS "Subject" FROM conversations""",
)
def chat(spark, d):
    subject = F.concat(F.lit("Conversation "), F.col("conv_id"))
    return chat_export(Tables(spark, d).conversations, ["conv_id"], "turn", "role", "text", subject)


@query(
    "pending_question",
    """SELECT conv_id, question FROM (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS question
    FROM conversations GROUP BY 1) WHERE role = 'user'""",
)
def pending(spark, d):
    return pending_question(Tables(spark, d).conversations, ["conv_id"], "turn", "role", "text")


@query(
    "fingerprint",
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM t),
    b AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_distinct(grams),
      lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % 2048))) AS bits FROM g)
    SELECT doc_id, len(bits) AS n_bits, array_to_string(bits, ',') AS bits FROM b""",
)
def fingerprint(spark, d):
    docs = spread(Tables(spark, d).documents.select("doc_id", "text"))
    bits = features.fingerprint(docs, "text", "b")
    return bits.select("doc_id", F.size("b").cast("bigint").alias("n_bits"), F.concat_ws(",", F.col("b").cast("array<string>")).alias("bits"))


def _hits(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS DOUBLE)"


@query(
    "featurize",
    rf"""SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, {_hits('[A-Z]')} AS n_upper, {_hits('[a-z]')} AS n_lower,
    {_hits('[0-9]')} AS n_digit, {_hits(r'[.,;:!?()=#@+\-]')} AS n_punct, {_hits('[A-Za-z]+')} AS n_tokens,
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines, FALSE AS failed FROM documents""",
)
def featurize(spark, d):
    return features.featurize(spread(Tables(spark, d).documents.select("doc_id", "text")), "text", keep=["doc_id"])


@query(
    "element_screen",
    """SELECT doc_id, lang FROM documents WHERE NOT list_has_any(regexp_extract_all(lower(text), '[a-z]+'), ['the', 'une', 'und'])""",
)
def element_screen(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "lang", "text")
    return features.element_screen(docs, "text", ["the", "une", "und"], tokens=text.words).drop("text")


@query(
    "largest_part",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents),
    n AS (SELECT doc_id, part, len(regexp_extract_all(part, '[A-Za-z0-9]')) AS n FROM p)
    SELECT doc_id, arg_max(part, (n, part)) AS part FROM n GROUP BY 1""",
)
def largest_part(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return features.keep_largest_part(docs, "text", ".", "part").drop("text")


@query(
    "canonical_key",
    r"""SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS canonical_key FROM documents WHERE lang <> 'de'""",
)
def canonical_key(spark, d):
    docs = Tables(spark, d).documents
    rows = docs.select("doc_id", F.when(F.col("lang") == "de", " ").otherwise(F.col("text")).alias("text"))
    return features.canonicalize(rows, "text").drop("text")


@query(
    "map_or_null",
    "SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / length(text) AS blank_share FROM documents",
)
def map_or_null(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")

    def share_of_blanks(t: str) -> float:
        return t.count(" ") / len(t)

    return udfs.map_or_null(docs, "text", share_of_blanks, "double", "blank_share").drop("text")


@query(
    "columnwise_apply",
    "SELECT l_orderkey, round(sqrt(l_quantity), 6) AS l_quantity, round(sqrt(l_tax), 6) AS l_tax FROM lineitem",
)
def columnwise_apply(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_quantity", "l_tax")
    return for_columns(li, ["l_quantity", "l_tax"], lambda c: F.round(F.sqrt(c), 6))


@query(
    "map_batches",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""",
)
def map_batches(spark, d):
    def norms(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": pdf["vec_id"], "norm": [float((v.astype("float64") ** 2).sum() ** 0.5) for v in pdf["embedding"]]})

    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    return rounded(udfs.map_batches(e, norms, "vec_id bigint, norm double"), 6, "norm")


@query(
    "featurize_user_function",
    """SELECT doc_id, CAST(length(lower(text)) - length(replace(lower(text), 'a', '')) AS DOUBLE) AS n_a,
    CAST(length(lower(text)) - length(replace(lower(text), 'e', '')) AS DOUBLE) AS n_e, FALSE AS failed FROM documents""",
)
def featurize_user_function(spark, d):
    def vowels(keys: pd.Series) -> pd.DataFrame:
        low = keys.str.lower()
        return pd.DataFrame({"n_a": low.str.count("a"), "n_e": low.str.count("e")})

    return features.featurize(Tables(spark, d).documents, "text", vowels, ["n_a", "n_e"], keep=["doc_id"])
