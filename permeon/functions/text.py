"""Text operators: clean-up, sentence ends, templates, links, key normalising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from permeon.functions.rounding import fixed

# Boiler-plate patterns, link prefix, prompt and templates.
BOILERPLATE_PATTERNS = (
    r"ABSTRACT.*?WORDS\)",
    r"LEARNING OBJECTIVE.*?:",
    r"DATA SOURCES.*?:",
    r"CONCLUSIONS?:",
)
SHORT_TAIL = 10
LINK_PREFIX = "https://chat.openai.com/?q="
LINK_PROMPT = (
    "Tell me more about {name} and its relevance in CNS drug discovery, "
    "with context of blood-brain barrier (BBB) penetration."
)
PROMPT_TEMPLATES = {
    "Summary": "Provide a concise summary about {compound} and its potential for blood-brain barrier penetration. "
    "Focus on key pharmacological properties:",
    "Key Facts": "List 3-5 key facts about {compound} related to CNS drug discovery and BBB penetration:",
    "Research Papers": "Mention important research findings about {compound} and blood-brain barrier permeability:",
    "Simple Explanation": "Explain in simple terms how {compound} interacts with the blood-brain barrier:",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space on both sides (``trim`` only takes blanks)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """Collapse white space and dot runs, cut boiler-plate, drop a short unfinished tail."""
    out = F.regexp_replace(_col(c), r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    for pattern in BOILERPLATE_PATTERNS:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    tail = F.substring_index(out, ".", -1)
    unfinished = (F.instr(out, ".") > 0) & (F.length(F.trim(tail)) < SHORT_TAIL)
    head = F.substring(out, F.lit(1), F.length(out) - F.length(tail))
    return F.trim(F.when(unfinished, head).otherwise(F.coalesce(out, F.lit(""))))


def complete_sentence(c: Column | str) -> Column:
    """Cut after the last sentence mark; without one, trim and add a full stop."""
    c = _col(c)
    upto = F.regexp_extract(c, r"(?s)^(.*[.!?])", 1)
    return (
        F.when(F.length(strip(c)) == 0, c)
        .when(F.length(upto) > 0, strip(upto))
        .otherwise(F.concat(strip(c), F.lit(".")))
    )


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` slots of a template with column values."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        parts += [F.lit(head), values[slot].cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def context_line(name: Column, prediction: Column, confidence: Column, mw: Column, logp: Column) -> Column:
    """Subject line for a prompt: confidence and weight with 1 decimal, logP with 2."""
    return render(
        "Compound: {name}. Prediction: {prediction} ({confidence}%). MW {mw}, LogP {logp}.",
        {
            "name": name,
            "prediction": prediction,
            "confidence": fixed(confidence, 1),
            "mw": fixed(mw, 1),
            "logp": fixed(logp, 2),
        },
    )


def percent_encode(c: Column | str) -> Column:
    """RFC 3986 encoding that leaves ``/`` and ``~`` alone."""
    out = F.url_encode(_col(c))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def link(name: Column | str) -> Column:
    return F.concat(F.lit(LINK_PREFIX), percent_encode(render(LINK_PROMPT, {"name": _col(name)})))


def normalise_key(c: Column | str) -> Column:
    """Canonical text key: one blank between words, lower case; blank gives NULL."""
    key = F.lower(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")))
    return F.when(F.length(key) > 0, key)


def words(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z]+"), F.lit(0))


# One structure token: a bracket atom's element, a two-letter element, or a one-letter one.
ELEMENT_PATTERN = r"\[[0-9]*([A-Z][a-z]?|[a-z])|(Cl|Br|[BCNOSPFI]|[bcnosp])"


def element_tokens(c: Column | str) -> Column:
    """Element symbols named in a line-notation structure string, upper-first."""
    found = F.regexp_extract_all(_col(c), F.lit(ELEMENT_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.initcap(F.regexp_replace(t, r"[\[0-9]", ""))))


def names_any(tokens: Column, banned: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(b) for b in banned]))


def largest_part(c: Column | str, sep: str = ".", token: str = r"[A-Za-z0-9]") -> Column:
    """The part with the most tokens; among equals the alphabetically last one."""
    parts = F.split(_col(c), F.lit("\\Q" + sep + "\\E"))
    sized = F.transform(parts, lambda p: F.struct(F.regexp_count(p, F.lit(token)).alias("n"), p.alias("part")))
    return F.array_max(sized)["part"]


# Symbols of the elements screened out as heavy (atomic numbers 21-118
# without 30, 35, 36, 53, 54), in periodic order.
HEAVY_ELEMENTS = tuple(
    "Sc Ti V Cr Mn Fe Co Ni Cu Ga Ge As Se Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te Cs Ba La Ce Pr Nd Pm Sm Eu "
    "Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm "
    "Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
)
