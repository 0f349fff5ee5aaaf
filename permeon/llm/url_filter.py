"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs. Here the rules label the URLs they fit; any
other labelled column does as well (:func:`fit_url_model`). Everything is column
expressions and Spark ML, so no Python runs on the executors.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is judged by its (all but empty) features. With labels of one class only, or
none, there is nothing to learn and the verdict is that class, or ``allow``.
Rows are judged one by one: repeated rows and null ids stay; columns other than
those named are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeon.llm.common import ascii_lower, let

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that one fit uses at most, drawn by the URL's hash.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Host suffixes share this many cells, which bounds the table of suffix statistics.
SUFFIX_CELLS = 4096
#: Pseudo-URLs that pull the block rate of a rare suffix to the overall rate.
SUFFIX_WEIGHT = 10.0

LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy",
    "n_parameters", "query_length", "hyphens", "has_fragment", "has_extension", "secure", "longest_label",
)


class Rule(NamedTuple):
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, found, 1)), F.regexp_extract(url, found, 2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution."""
    chars = F.array_remove(F.split(text, ""), "")
    runs = let(
        F.sort_array(chars),
        # Places where a run of equal characters starts, in order, and the end.
        lambda s: F.concat(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), F.array(F.size(s))
        ),
    )
    total = F.char_length(text).cast("double")
    sizes = let(runs, lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x, i: (F.get(r, i + 1) - x).cast("double")))
    bits = F.aggregate(sizes, F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.when(total > 0, F.log2(total) - bits / total).otherwise(F.lit(0.0))


def _suffix_cell(host: Column, labels: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(labels), F.substring_index(host, ".", -labels)), F.lit(SUFFIX_CELLS)).cast("int")


def lexical_features(rows: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host``, ``path`` and the cells of the host's suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    tail = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.greatest(F.char_length(url), F.lit(1))
    values = {
        "url_length": F.char_length(url),
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "host_depth": F.size(F.split("host", r"\.")),
        "path_depth": F.size(F.array_remove(F.split("path", "/"), "")),
        "digit_ratio": F.char_length(F.regexp_replace(url, "[^0-9]", "")) / length,
        "entropy": _entropy(url),
        "n_parameters": F.size(F.array_remove(F.split(tail, "&"), "")),
        "query_length": F.char_length(tail),
        "hyphens": F.char_length(F.regexp_replace(url, "[^_-]", "")),
        "has_fragment": F.contains(url, F.lit("#")),
        "has_extension": F.regexp_like("path", F.lit(r"\.[A-Za-z0-9]{1,5}$")),
        "secure": url.startswith("https:"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.char_length)),
    }
    return rows.withColumns(
        {k: v.cast("double") for k, v in values.items()} | {"cell_1": _suffix_cell(F.col("host"), 1), "cell_2": _suffix_cell(F.col("host"), 2)}
    )


class UrlModel(NamedTuple):
    """Trees and suffix statistics; without trees, the verdict that all labels had."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    only: str


def _with_suffixes(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds block rate and frequency of either suffix; the table has at most 2 * SUFFIX_CELLS rows."""
    for n in (1, 2):
        part = suffixes.where(F.col("labels") == n).select(F.col("cell").alias(f"cell_{n}"), F.col("rate").alias(f"rate_{n}"), F.col("seen").alias(f"seen_{n}"))
        rows = rows.join(F.broadcast(part), f"cell_{n}", "left")
    return rows


def _assembled(rows: DataFrame, prior: float | None = None) -> DataFrame:
    cols = [*LEXICAL, "rate_1", "seen_1", "rate_2", "seen_2"]
    filled = rows.na.fill(0.0, ["seen_1", "seen_2"]).na.fill(0.5 if prior is None else prior, ["rate_1", "rate_2"])
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(filled)


def fit_url_model(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> UrlModel:
    """Trees from rows with url, host, path and ``verdict``.

    The suffix statistics count every labelled row. The trees see at most about
    ``max_rows`` of them, drawn by a hash of the URL.
    """
    rows = lexical_features(labelled).withColumn("label", (F.col("verdict") == BLOCK).cast("double"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return UrlModel(None, None, BLOCK if 1.0 in sizes else ALLOW)
    total = sum(sizes.values())
    rate = sizes[1.0] / total
    cells = rows.select("label", F.explode(F.array(*(F.struct(F.lit(n).alias("labels"), F.col(f"cell_{n}").alias("cell")) for n in (1, 2)))).alias("c"))
    counted = cells.groupBy("c.labels", "c.cell").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    suffixes = counted.select(
        "labels",
        "cell",
        ((F.col("blocked") + SUFFIX_WEIGHT * rate) / (F.col("n") + SUFFIX_WEIGHT)).alias("rate"),
        F.log1p((F.col("n") / total).cast("double")).alias("seen"),
    )
    # A bounded table: fixed now, so that no later plan counts the corpus again.
    suffixes = labelled.sparkSession.createDataFrame(suffixes.collect(), suffixes.schema)
    share = min(1.0, max_rows / total)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = _assembled(_with_suffixes(drawn, suffixes)).select("label", "features").coalesce(8).cache()
    try:
        if train.select("label").distinct().count() < 2:
            return UrlModel(None, None, BLOCK if rate > 0.5 else ALLOW)
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED).fit(train)
    finally:
        train.unpersist()
    return UrlModel(trees, suffixes, ALLOW)


def block_score(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Adds ``score``, the model's probability of ``block``, to rows with url, host, path."""
    if model.trees is None:
        return rows.withColumn("score", F.lit(1.0 if model.only == BLOCK else 0.0))
    scored = model.trees.transform(_assembled(_with_suffixes(lexical_features(rows), model.suffixes)))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def filter_urls(pages: DataFrame, rules: list[Rule], max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """page_id, url, host, path, rule, verdict and the model's score of every page."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    model = fit_url_model(rows.where("ruled IS NOT NULL").withColumnRenamed("ruled", "verdict"), max_rows)
    learnt = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return block_score(rows, model).select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "score")
