"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training follows the regularised leader (FTRL-proximal) with an elastic-net
penalty; a temperature, fitted on rows that training has not seen, calibrates the
probabilities.

Document frequencies count every learnable text. The regression sees at most about
ROWS_PER_LANGUAGE distinct texts of each language, drawn by the text's hash, whose
n-gram counts (not texts) come to the driver. The model, CELLS numbers for each
language, is broadcast, and prediction is one narrow pass over whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Without labelled rows all texts are ``und``. Rows are judged one by one: repeated
rows and null ids stay; columns other than those named are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.llm.common import LOWER, in_arrow, mix, text_blocks

UNKNOWN = "und"
ORDERS = (1, 2, 3)
CELLS = 1 << 15
#: Bound of the classifier's sample, by language, in distinct texts.
ROWS_PER_LANGUAGE = 400
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001

LETTER = regex.compile(r"\p{L}")


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per character (A-Z and À-Þ lower-cased), and the documents' offsets in characters."""
    low = LOWER[data]
    second = np.zeros(len(low), bool)
    second[1:] = low[:-1] == 0xC3
    low[second & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    head = (low & 0xC0) != 0x80
    place = np.flatnonzero(head)
    codes = low[place].astype(np.uint64)
    wide = np.flatnonzero(codes >= 0xC0)
    if len(wide):
        at, code = place[wide], codes[wide]
        last = len(low) - 1
        for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            more = low[at] >= least
            code[more] = code[more] * np.uint64(256) + low[np.minimum(at[more] + i, last)]
        codes[wide] = code
    return codes, np.searchsorted(place, offsets)


def ngram_cells(codes: np.ndarray, orders=ORDERS) -> list[np.ndarray]:
    """For each n, the cell of the n-gram that starts at each character."""
    cells, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            cells.append(np.zeros(0, np.int64))
            continue
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n in orders:
            cells.append((mix(h) >> np.uint64(49)).astype(np.int64))
    return cells


def counts_by_document(column: pa.Array):
    """(cells, counts) of every text of a column, in order."""
    for block in text_blocks(column):
        codes, offsets = characters(block.data, block.offsets)
        cells = ngram_cells(codes)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            total = np.zeros(CELLS, np.int64)
            for n, of_n in zip(ORDERS, cells, strict=True):
                if b - a >= n:
                    total += np.bincount(of_n[a : b - n + 1], minlength=CELLS)
            found = np.flatnonzero(total)
            yield found, total[found]


class LanguageModel(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF with logarithmic counts, of length 1."""
        return tf_idf(self.idf, cells, counts)

    def predict(self, cells: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = softmax((self.weights[:, cells] @ self.features(cells, counts) + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def tf_idf(idf: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[cells]
    return v / max(np.sqrt(v @ v), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, cells: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (class, cells, values) rows, in the order given, ``epochs`` times."""
    z, n = np.zeros((classes, cells + 1)), np.zeros((classes, cells + 1))

    def current(zs, ns):
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for label, found, values in rows:
            at, x = np.append(found, cells), np.append(values, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = current(zs, ns)
            error = softmax(w @ x)
            error[label] -= 1
            g = error[:, None] * x
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = more
    w = current(z, n)
    return w[:, :-1], w[:, -1]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, golden = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches):
    total, texts = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        for found, _ in counts_by_document(batch.column(0)):
            total[found] += 1
            texts += 1
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(CELLS), -1), pa.int32()), pa.array(np.append(total, texts), pa.int64())], ["cell", "df"])


def _sampled(batches):
    for batch in batches:
        rows = list(counts_by_document(batch.column(0)))
        if rows:
            packed = [(c.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes()) for c, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["lang", "draw", "cells", "counts"])


def fit_language_model(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """A model from the text and lang of ``docs``; None without labelled rows.

    It learns from about ``rows_per_language`` distinct texts of each language, all if there are
    fewer; copies of a text count once. Each language takes 128 KB of the model, and
    half a MB of the driver while it is fitted.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    texts_of = known.select("lang", F.xxhash64("text").alias("draw")).distinct()
    sizes = {r[0]: r[1] for r in texts_of.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    df = known.select("text").transform(in_arrow, _frequencies, "cell int, df bigint").groupBy("cell").agg(F.sum("df").alias("df")).collect()
    freq = np.zeros(CELLS)
    texts = next(r[1] for r in df if r[0] == -1)
    for r in df:
        if r[0] >= 0:
            freq[r[0]] = r[1]
    idf = np.log((1 + texts) / (1 + freq)) + 1

    space = 1 << 20
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, int(space * min(1.0, rows_per_language / sizes[k])))))
    hashed = known.withColumn("draw", F.xxhash64("text"))
    drawn = hashed.where(F.pmod("draw", F.lit(space)) < F.element_at(share, F.col("lang")))
    # Of the few that are drawn, one copy of each text; the text of least order stands for a hash.
    drawn = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).select("text", "lang", "draw")
    sample = drawn.transform(in_arrow, _sampled, "lang string, draw bigint, cells binary, counts binary").collect()
    rows = []
    for r in sorted(sample, key=lambda r: (hash_order(r["draw"]), r["draw"], r["lang"])):
        cells, counts = np.frombuffer(r["cells"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32)
        rows.append((languages.index(r["lang"]), cells, tf_idf(idf, cells, counts) if len(cells) else np.zeros(0)))
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    weights, bias = ftrl([r for i, r in enumerate(rows) if i % 5 != 4], len(languages), CELLS)
    scores = np.array([weights[:, c] @ v + bias for _, c, v in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), bias, best_temperature(scores, np.array([r[0] for r in held], int)))


def hash_order(x: int) -> int:
    """Shuffles the draw's order, so that languages with few rows do not come last."""
    return (x * 0x9E3779B1) & 0xFFFFFFFF


def identify_language(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score (0 to 1)."""
    rows = docs.select(F.col("text").alias("_text"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for batch in batches:
            texts, found = batch.column(0), ([], [])
            for i, (cells, counts) in enumerate(counts_by_document(texts)):
                known = model is not None and len(cells) and LETTER.search(texts[i].as_py()) is not None
                lang, score = model.predict(cells, counts) if known else (UNKNOWN, 0.0)
                found[0].append(lang)
                found[1].append(score)
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], [f.name for f in fields] + ["lang_pred", "score"])

    return rows.transform(in_arrow, predict, schema)
