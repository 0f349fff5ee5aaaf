"""Small tables with the awkward cases every operator has to bear."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

SYLLABLES = ["tion", "th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]


def prose(seed: int, words: int, syllables=SYLLABLES) -> str:
    rng = random.Random(seed)
    out, sentence = [], 0
    for _ in range(words):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if not sentence else w)
        sentence = (sentence + 1) % rng.randint(6, 12)
        if not sentence:
            out[-1] += "."
    return " ".join(out)


def documents(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


#: Null and empty texts, only blanks, one word, characters of one to four bytes, repeated rows, null ids.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One"),
    (5, "été ÉTÉ naïve 東京 𝔘𝔫𝔦 word"),
    (5, "été ÉTÉ naïve 東京 𝔘𝔫𝔦 word"),
    (None, "a text without an id that is a little longer than the others"),
    (None, None),
    (6, "##### 12345 !!!!! -----"),
    (7, "x" * 5000),
    (8, "tab\tand\x0bother\x0cblanks\r\nhere"),
]


def clashing(docs):
    """The same rows with more columns, named like those the operators make."""
    from pyspark.sql import functions as F

    names = ["score", "key", "fp", "shard", "size", "row", "_row", "_text", "_id", "_hash", "lang_pred", "h", "n", "kept", "_group", "held_out"]
    return docs.withColumns({n: F.lit("other") for n in names})
