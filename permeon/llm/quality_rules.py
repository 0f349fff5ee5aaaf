r"""Quality rules by weak supervision.

Every rule votes for (1), against (0) or abstains (null). Expectation-maximisation
over the counts of vote patterns estimates how often each rule is right on good
and on bad texts; the posterior probability of "good" then decides, so that a
single failed rule does not condemn a text.

All of it is column expressions. The driver sees only the pattern counts, at most
3 ** (number of rules) rows, whatever the size of the corpus.

Defined results: a null or empty text has no words, fails the base rules and is
not kept. Rows are judged one by one, so repeated rows and null ids are kept as
they come; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 60
#: Where EM starts, and what it keeps to where votes are few: a rule is seldom against a good
#: text, and finds about one bad text of three. The weight counts as so many votes.
FOR_GOOD, AGAINST_BAD, PRIOR_VOTES = 0.98, 0.3, 20.0
#: Pseudo-documents of either class.
PRIOR_GOOD, PRIOR_BAD = 4.0, 1.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(words: Column) -> Column:
    """Sorted (hash, place) of every window of three words."""
    windows = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(
        F.transform(
            windows,
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )


def _same(windows: Column, x: Column, k: Column) -> Column:
    return F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts, and the further counts the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.withColumns({"_words": F.array_remove(F.split("_text", BLANKS), ""), "_lines": F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))})
    rows = rows.withColumn("_windows", _repeats(F.col("_words")))
    rows = rows.withColumn(
        "_places",
        F.sort_array(F.filter("_windows", lambda x, k: _same(F.col("_windows"), x, k - 1) | _same(F.col("_windows"), x, k + 1))["i"]),
    )
    places = F.col("_places")
    covered = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("_text", F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_text", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("_text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def _vote(against: Column, favour: Column) -> Column:
    return F.when(against, F.lit(0)).when(favour, F.lit(1))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))




def rules() -> dict[str, Column]:
    """The rules by name, each a vote over the columns of :func:`text_features`."""
    length, symbols, lines = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeats, capitals, digits = _share("n_repeat_words", "n_words"), _share("n_capitals", "word_chars"), _share("n_digits", "word_chars")
    variety, letters = _share("n_distinct", "n_words"), _share("n_letters", "word_chars")
    return {
        "size": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 80),
        "word_length": _vote((length < 2.5) | (length > 12), (length >= 3) & (length <= 10)),
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "letters": _vote(letters < 0.88, letters > 0.93),
        "lines": _vote((lines > 0.3) & (F.col("n_dup_lines") > 2), (F.col("n_lines") > 1) & (lines < 0.05)),
        "repeats": _vote(repeats > 0.3, repeats < 0.1),
        "capitals": _vote(capitals > 0.3, capitals < 0.1),
        "digits": _vote(digits > 0.2, digits < 0.05),
        "variety": _vote(variety < 0.2, variety > 0.3),
    }


def fit(patterns: list[tuple[tuple, int]], n_rules: int, rounds: int = ROUNDS) -> dict:
    """EM over (votes, count) pairs: share of good texts and, per rule, P(vote 1 | good) and P(vote 0 | bad).

    With no patterns the priors are returned.
    """
    model = {"good": PRIOR_GOOD / (PRIOR_GOOD + PRIOR_BAD), "for_good": [FOR_GOOD] * n_rules, "against_bad": [AGAINST_BAD] * n_rules}
    for _ in range(rounds):
        good, bad = PRIOR_GOOD, PRIOR_BAD
        hits = [[FOR_GOOD * PRIOR_VOTES, PRIOR_VOTES, AGAINST_BAD * PRIOR_VOTES, PRIOR_VOTES] for _ in range(n_rules)]
        for votes, count in patterns:
            p = count / (1 + math.exp(-max(-500.0, min(500.0, log_odds(model, votes)))))
            q = count - p
            good, bad = good + p, bad + q
            for h, v in zip(hits, votes, strict=True):
                if v is not None:
                    h[0] += p * v
                    h[1] += p
                    h[2] += q * (1 - v)
                    h[3] += q
        model = {"good": good / (good + bad), "for_good": [h[0] / h[1] for h in hits], "against_bad": [h[2] / h[3] for h in hits]}
    return model


def weights(model: dict) -> list[tuple[float, float]]:
    """Per rule, the log-odds that a vote for and a vote against add."""
    return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(model["for_good"], model["against_bad"], strict=True)]


def log_odds(model: dict, votes) -> float:
    """Log-odds of "good" given the votes."""
    prior = math.log(model["good"] / (1 - model["good"]))
    return prior + sum(w[0] if v else w[1] for w, v in zip(weights(model), votes, strict=True) if v is not None)


def posterior(model: dict, votes: list[Column]) -> Column:
    """:func:`log_odds` as a probability, in column form."""
    total = F.lit(math.log(model["good"] / (1 - model["good"])))
    for (favour, against), v in zip(weights(model), votes, strict=True):
        total = total + F.when(v == 1, F.lit(favour)).when(v == 0, F.lit(against)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: the base counts, base_failed, the posterior probability and kept.

    The texts are read once; the counts (a few numbers a row) are stored for the
    fit and for the verdicts.
    """
    named = rules()
    votes = list(named)
    rows = stored(text_features(docs).withColumns({f"vote_{k}": v for k, v in named.items()}), "quality")
    cols = [F.col(f"vote_{k}") for k in votes]
    counted = rows.groupBy(*cols).count().collect()
    model = fit(sorted(((tuple(r[:-1]), r[-1]) for r in counted), key=str), len(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        (~failed & (posterior(model, cols) >= threshold)).alias("kept"),
        posterior(model, cols).alias("posterior"),
        *cols,
    )
