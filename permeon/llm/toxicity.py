"""Toxicity by maximum-scoring segments.

Every token has a log-odds score, toxic against clean, with Dirichlet priors: a
word's prior is centred on what its stem (first bytes) shows, the stem's on the
pooled corpus, so unseen forms of a known stem score like it. A linear-time scan
finds all maximal scoring segments of a text. Their scores are judged against the
extreme-value law that the best segments of clean texts follow, which takes the
text's length into account, and a logistic curve turns the evidence into a
probability.

The classifier learns from at most about LABELLED_ROWS labels, drawn by their id's
hash; that bounds the labels that are broadcast to find their texts, so texts are
never shuffled. Token counts live in a fixed number of cells, which bounds the
model. The curves are fitted on rows that the counts have not seen.
Scoring is one narrow pass over whole texts.

Defined results: a null or empty text has no segment and scores lowest. Labels
that are null, or whose doc_id is null, are not learnt from; of several labels of
a doc_id the highest holds. Without labels the score is 0. Rows are judged one by
one: repeated rows and null ids stay; columns other than those named are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.llm.common import LOWER, WORD_BYTES, in_arrow, range_hashes, split_words, stored, text_blocks

WORD_CELLS, STEM_CELLS = 1 << 20, 1 << 18
STEM_BYTES = 5
#: Pseudo-counts of the priors of words and stems.
WORD_PRIOR, STEM_PRIOR = 8.0, 30.0
#: What every token costs, so that chance gains do not add up; bounds of one token's score.
COST, LEAST, MOST = 0.25, -1.5, 10.0
#: One learnable row in so many is kept from the counts, to fit the curves.
CALIBRATION_PART = 5
#: Bound of the classifier's sample of labels.
LABELLED_ROWS = 40_000


def token_cells(data: np.ndarray, offsets: np.ndarray):
    """Words of a block, and the word and stem cell of each."""
    low = LOWER[data]
    words = split_words(low, offsets, WORD_BYTES)
    whole = range_hashes(low, words.starts, words.ends)
    stem = range_hashes(low, words.starts, np.minimum(words.ends, words.starts + STEM_BYTES))
    return words, (whole % np.uint64(WORD_CELLS)).astype(np.int64), (stem % np.uint64(STEM_CELLS)).astype(np.int64)


class TokenScores(NamedTuple):
    """Counts by word cell (toxic, clean) and log-odds by stem cell.

    A call gives the tokens' log-odds; gains are taken at their lower standard deviation.
    """

    toxic: np.ndarray
    clean: np.ndarray
    stem: np.ndarray
    n_toxic: float
    n_clean: float

    def __call__(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        ratio = math.log(self.n_toxic / self.n_clean)
        share = 1 / (1 + np.exp(-(self.stem[stem] + ratio)))
        toxic, clean = self.toxic[word] + WORD_PRIOR * share, self.clean[word] + WORD_PRIOR * (1 - share)
        odds = np.log(toxic / clean) - ratio
        sure = np.maximum(0, odds - np.sqrt(1 / toxic + 1 / clean))
        return np.clip(np.where(odds > 0, sure, odds), LEAST, MOST)


def token_scores(toxic, clean, stem_toxic, stem_clean) -> TokenScores:
    n1, n0 = max(toxic.sum(), 1.0), max(clean.sum(), 1.0)
    share = n1 / (n1 + n0)
    stem = np.log((stem_toxic + STEM_PRIOR * share) / (stem_clean + STEM_PRIOR * (1 - share))) - math.log(n1 / n0)
    return TokenScores(toxic.astype(np.float32), clean.astype(np.float32), stem.astype(np.float32), n1, n0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), left to right, in linear time.

    Each candidate remembers the nearest earlier one with a lower left sum; the
    search follows these links instead of going back one by one.
    """
    gains = scores > 0
    if not gains.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gains, [False])).astype(np.int8)))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    first, end, left, right, link = [], [], [], [], []
    for a, b, low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), sums[edges[::2]].tolist(), sums[edges[1::2]].tolist(), strict=True):
        while True:
            j = len(first) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            a, low = first[j], left[j]
            del first[j:], end[j:], left[j:], right[j:], link[j:]
        first.append(a)
        end.append(b)
        left.append(low)
        right.append(high)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(first, end, left, right, strict=True)]


class Calibration(NamedTuple):
    """The extreme-value law P(best < s) = exp(-k n exp(-scale s)), and the logistic curve over evidence."""

    scale: float
    k: float
    curve: tuple[float, float, float] | None

    def evidence(self, n: int, segments: list[float]) -> tuple[float, float]:
        """Surprise of the best segment, and the sum over all segments that are significant by themselves."""
        base = math.log(self.k * max(n, 1))
        surprise = [self.scale * s - base for s in segments]
        return max(surprise, default=-base), math.log1p(sum(x for x in surprise if x > 0))

    def probability(self, n: int, segments: list[float]) -> float:
        best, total = self.evidence(n, segments)
        if self.curve is None:
            return math.exp(-math.exp(min(-best, 50.0)))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * max(-20.0, min(60.0, best)) + c * total))))


def extreme_value_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (scale, k) from the lengths and best segments of clean texts."""
    if not len(n):
        return 1.0, 0.1
    n = np.maximum(n, 1)

    def k_of(scale: float) -> float:
        return len(n) / float((n * np.exp(-scale * best)).sum())

    def loss(scale: float) -> float:
        k = k_of(scale)
        return -float((math.log(k * scale) + np.log(n) - scale * best - k * n * np.exp(-scale * best)).sum())

    low, high, golden = 0.02, 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    scale = (low + high) / 2
    return scale, k_of(scale)


def logistic_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


class ToxicityModel(NamedTuple):
    tokens: TokenScores
    calibration: Calibration


def _counted(batches):
    """Per word (kind 0) and stem (kind 1) cell, the clean and toxic texts that have it."""
    counts = [np.zeros((2, WORD_CELLS), np.int64), np.zeros((2, STEM_CELLS), np.int64)]
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for block in text_blocks(batch.column(0)):
            words, whole, stem = token_cells(block.data, block.offsets)
            text = np.repeat(np.arange(block.first, block.last), np.diff(words.first))
            for total, cell in zip(counts, (whole, stem), strict=True):
                n = total.shape[1]
                once = np.unique(text * n + cell)
                of_class = toxic[once // n]
                for c in (0, 1):
                    total[c] += np.bincount(once[of_class == c] % n, minlength=n)
    for kind, total in enumerate(counts):
        found = np.flatnonzero(total.sum(axis=0))
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), kind), pa.int32()), pa.array(found, pa.int32()), pa.array(total[0, found]), pa.array(total[1, found])],
                ["kind", "cell", "clean", "toxic"],
            )


def _segments(tokens: TokenScores, column: pa.Array):
    """(number of tokens, segments, byte ranges of the tokens) of every text."""
    for block in text_blocks(column):
        words, whole, stem = token_cells(block.data, block.offsets)
        scores = tokens(whole, stem).astype(np.float64)
        # A word's k-th occurrence in a text gains a k-th of the first, or a word said over and over would do.
        gains = np.flatnonzero(scores > 0)
        text = np.searchsorted(words.first, gains, "right")
        order = np.lexsort((gains, whole[gains], text))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(whole[gains][order]) != 0) | (np.diff(text[order]) != 0)
        begin = np.flatnonzero(head)
        scores[gains[order]] /= np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
        scores -= COST
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            yield int(b - a), maximal_segments(scores[a:b]), (words.starts[a:b] - block.offsets[i], words.ends[a:b] - block.offsets[i])


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS) -> DataFrame:
    """text and toxic (0 or 1) of the documents that have one of about ``max_rows`` labels.

    A half of these at most are toxic ones; what they leave goes to the others.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = dict(marks.groupBy("toxic").count().collect())
    space = 1 << 30
    toxic = min(sizes.get(1, 0), max_rows // 2)
    share = {1: min(1.0, toxic / max(1, sizes.get(1, 0))), 0: min(1.0, (max_rows - toxic) / max(1, sizes.get(0, 0)))}
    limit = F.when(F.col("toxic") == 1, int(share[1] * space)).otherwise(int(share[0] * space))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < limit)
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def fit_toxicity(labelled: DataFrame) -> ToxicityModel | None:
    """A model from rows of text and toxic; None without toxic rows."""
    spark = labelled.sparkSession
    rows = stored(labelled.withColumn("_draw", F.pmod(F.xxhash64("text"), F.lit(1 << 30))), "toxicity-labelled")
    parts = rows.groupBy((F.col("_draw") % CALIBRATION_PART == 0).alias("kept")).agg(F.count("*"), F.sum("toxic")).collect()
    sizes = {r[0]: (r[1], r[2]) for r in parts}
    if not sizes.get(False, (0, 0))[1]:
        return None
    # Of equal texts one counts, so that copies of a toxic text do not make its every word suspicious.
    counting = rows.where(F.col("_draw") % CALIBRATION_PART != 0).dropDuplicates(["text", "toxic"]).select("text", "toxic")
    cells = counting.transform(in_arrow, _counted, "kind int, cell int, clean bigint, toxic bigint").groupBy("kind", "cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    kind, cell = cells.column("kind").to_numpy(), cells.column("cell").to_numpy()
    totals = []
    for k, size in ((0, WORD_CELLS), (1, STEM_CELLS)):
        for c in ("toxic", "clean"):
            of = np.zeros(size)
            of[cell[kind == k]] = cells.column(c).to_numpy()[kind == k]
            totals.append(of)
    tokens = token_scores(*totals)
    shared = spark.sparkContext.broadcast(tokens)

    def best(batches):
        for batch in batches:
            found = [(n, max((s for _, _, s in segments), default=0.0)) for n, segments, _ in _segments(shared.value, batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["toxic", "n", "best"])

    kept = rows.where(F.col("_draw") % CALIBRATION_PART == 0).select("text", "toxic")
    clean = sorted((r["n"], r["best"]) for r in kept.where("toxic = 0").transform(in_arrow, best, "toxic int, n bigint, best double").collect())
    law = Calibration(*extreme_value_law(np.array([n for n, _ in clean]), np.array([b for _, b in clean])), None)

    def weighed(batches):
        """The evidence of every text, over all of its segments, now that the law is known."""
        for batch in batches:
            found = [law.evidence(n, [s for _, _, s in segments]) for n, segments, _ in _segments(shared.value, batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1))], ["toxic", "surprise", "total"])

    known = sorted(tuple(r) for r in kept.transform(in_arrow, weighed, "toxic int, surprise double, total double").collect())
    y = np.array([float(r[0]) for r in known])
    if 0 < y.sum() < len(y):
        law = law._replace(curve=logistic_curve(np.clip(np.array([r[1:] for r in known]), -20, 60), y))
    return ToxicityModel(tokens, law)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with score, n_segments and the passages found.

    A passage is a segment that is significant by itself, as (first, end) UTF-8
    bytes in the text and its score.
    """
    rows = docs.select(F.col("text").alias("_text"), *keep)
    fields = rows.schema.fields[1:]
    names = [f.name for f in fields] + ["score", "passages"]
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("passages", spans)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = shared.value
        for batch in batches:
            scores, passages = [], []
            if model is None:
                scores, passages = [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            else:
                law = model.calibration
                for n, segments, (starts, ends) in _segments(model.tokens, batch.column(0)):
                    scores.append(law.probability(n, [s for _, _, s in segments]))
                    least = math.log(law.k * max(n, 1)) / law.scale
                    passages.append([{"first": int(starts[a]), "end": int(ends[b - 1]), "score": s} for a, b, s in segments if s > least])
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names)

    return rows.transform(in_arrow, scored, schema)
