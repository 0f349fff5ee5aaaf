"""Text operators and payload cells."""

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from permeon.functions import payload, text
from permeon.operators import udfs
from permeon.plans.display import chat_export, pending_question


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def test_clean_text(spark):
    got = values(
        spark,
        text.clean_text,
        ["", None, "a  b\n\nc", "One... Two. tail", "One. A long enough tail", "ABSTRACT (250 words) Start. conclusion: End.", "no stop"],
    )
    assert got == ["", "", "a b c", "One. Two.", "One. A long enough tail", "Start.  End.", "no stop"]  # white space is collapsed before the cuts


def test_complete_sentence(spark):
    got = values(spark, text.complete_sentence, ["", "  ", "Done! and more", "a.\nb? c", " none ", "Ends."])
    assert got == ["", "  ", "Done!", "a.\nb?", "none.", "Ends."]


def test_links(spark):
    names = ["aspirin", "a b/c~d*e", "naïve+é", "100%?&="]
    want = [text.LINK_PREFIX + quote(text.LINK_PROMPT.format(name=n)) for n in names]
    assert values(spark, text.link, names) == want


def test_templates(spark):
    for template in text.PROMPT_TEMPLATES.values():
        got = values(spark, lambda c, t=template: text.render(t, {"compound": F.col(c)}), ["X"])
        assert got == [template.format(compound="X")]


def test_payload(spark):
    raw = [
        '{"molecules": [{"molecule_chembl_id": "C1", "pref_name": null, "molecule_structures": null}]}',
        '{"molecules": [{"molecule_chembl_id": "C2", "pref_name": "N", "molecule_structures": {"canonical_smiles": "CC"}}, {"molecule_chembl_id": "C3"}]}',
        '{"molecules": []}',
        "broken",
    ]
    got = values(spark, lambda c: payload.project_payload(c, F.lit("given")), raw)
    assert (got[0]["hit_id"], got[0]["name"], got[0]["smiles"]) == ("C1", "given", None)
    assert (got[1]["hit_id"], got[1]["name"], got[1]["smiles"]) == ("C2", "N", "CC")
    assert got[2] is None and got[3] is None


def test_cells(spark):
    refs = values(spark, payload.reference_cell, ["{'DailyMed': [{'ref_id': '1', 'ref_url': 'u'}], 'FDA': []}"])[0]
    assert refs["DailyMed"][0]["ref_url"] == "u" and refs["FDA"] == []
    assert values(spark, payload.property_cell, ["TYPE = IC50 | RATIO = 2"])[0] == {"TYPE": "IC50", "RATIO": "2"}


def test_chat(spark):
    chat = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 1, "user", "why"), (2, 0, "system", "s")],
        "conv int, turn int, role string, msg string",
    )
    assert [tuple(r) for r in pending_question(chat, ["conv"], "turn", "role", "msg").collect()] == [(2, "why")]
    out = chat_export(chat, ["conv"], "turn", "role", "msg", F.lit("m"), F.lit("2024-01-01 00:00:00"))
    assert [r["Role"] for r in out.collect()] == ["User", "Assistant", "System", "User"]
    assert out.columns == ["conv", "turn", "Timestamp", "Role", "Message", "Subject"]


def test_user_functions(spark):
    df = spark.createDataFrame([("2",), ("x",), (None,)], "t string")
    got = udfs.map_or_null(df, "t", lambda v: float(v) * 2, "double", "d").collect()
    assert [r["d"] for r in got] == [4.0, None, None]
    assert [r["u"] for r in udfs.map_expression(df, "t", F.upper, "u").collect()] == ["2", "X", None]
    grouped = udfs.map_batches(df, lambda p: p.assign(n=len(p)).head(1), "t string, n bigint", by=["t"])
    assert sorted(r["n"] for r in grouped.collect()) == [1, 1, 1]


@pytest.mark.parametrize("sep", [".", "|"])
def test_largest_part_with_any_separator(spark, sep):
    assert values(spark, lambda c: text.largest_part(c, sep), [f"Cl{sep}CCCO{sep}[Na+]"]) == ["CCCO"]
