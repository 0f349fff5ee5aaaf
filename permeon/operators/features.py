"""Feature preparation.

Fits are eager and return one small record per column, as Spark ML estimators
do; applying them is a projection of literals that needs no join and stays in
generated code.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.cleaning import clip, finite_or_null, impute_constant
from permeon.functions.text import element_tokens, largest_part, names_any, normalise_key, words
from permeon.operators.projection import for_columns
from permeon.operators.quantiles import approx_quantiles, exact_quantiles
from permeon.session import bound_batches, release_memory

# Hard clip, winsor quantiles, variance limit, fingerprint length.
HARD_CLIP = 1e6
WINSOR = (0.001, 0.999)
MIN_VARIANCE = 0.1
N_BITS = 2048


def sanitize(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """±inf to missing, missing to the column median, a column without values to 0."""
    med = (exact_quantiles if exact else approx_quantiles)(df, cols, [0.5])
    fill = {c: v[0] if v[0] is not None else 0.0 for c, v in med.items()}
    return df.select(
        *[
            F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(fill[c])).alias(c) if c in fill else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def impute_const(
    df: DataFrame, cols: Sequence[str], missing: float = 0.0, posinf: float | None = None, neginf: float | None = None
) -> DataFrame:
    return for_columns(df, cols, lambda c: impute_constant(c, missing, posinf, neginf))


def hard_clip(df: DataFrame, cols: Sequence[str], lo: float = -HARD_CLIP, hi: float = HARD_CLIP) -> DataFrame:
    return for_columns(df, cols, lambda c: clip(c, lo, hi))


def winsorize(df: DataFrame, cols: Sequence[str], probs: tuple[float, float] = WINSOR, exact: bool = True) -> DataFrame:
    """Clamp each column to its own quantiles; missing cells stay, a column without values turns 0."""
    ends = (exact_quantiles if exact else approx_quantiles)(df, cols, list(probs))

    def one(name: str) -> Column:
        lo, hi = ends[name]
        c = F.col(f"`{name}`").cast("double")
        return F.lit(0.0) if lo is None else clip(F.when(~F.isnan(c), c), lo, hi)

    return df.select(*[one(c).alias(c) if c in ends else F.col(f"`{c}`") for c in df.columns])


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = MIN_VARIANCE) -> list[str]:
    """Columns whose population variance is above the threshold."""
    row = df.agg(*[F.var_pop(finite_or_null(F.col(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"v{i}"] is not None and row[f"v{i}"] > threshold]


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature, in feature order."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def scaled(self, c: Column, i: int) -> Column:
        std = self.stds[i] or 1.0
        return (c - F.lit(self.means[i])) / F.lit(std)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Mean and deviation of the finite values; NULL, NaN and the infinities do not count."""
    row = df.agg(
        *[
            e
            for i, c in enumerate(cols)
            for v in (finite_or_null(F.col(f"`{c}`")),)
            for e in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))
        ]
    ).first()
    return Scaler(
        tuple(cols),
        tuple(row[f"m{i}"] or 0.0 for i in range(len(cols))),
        tuple(row[f"s{i}"] or 0.0 for i in range(len(cols))),
    )


def apply_scaler(df: DataFrame, scaler: Scaler | None) -> DataFrame:
    """Standardised columns; without a saved scaler the rows pass through unscaled."""
    if scaler is None:
        return df
    place = {c: i for i, c in enumerate(scaler.names)}
    return df.select(
        *[scaler.scaled(F.col(f"`{c}`"), place[c]).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns]
    )


def fit_array_scaler(df: DataFrame, features: str) -> Scaler:
    """The same for an array column, the form for very wide feature blocks."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(F.col(features).cast("array<double>"))
    )
    s = df.filter(F.col(features).isNotNull()).select(stats.alias("s")).first()["s"]
    n = s["count"]
    pop = [(v * (n - 1) / n) ** 0.5 if n > 1 else 0.0 for v in s["variance"].toArray()]
    mean = [float(m) for m in s["mean"].toArray()]
    return Scaler(tuple(str(i) for i in range(len(mean))), tuple(mean), tuple(float(x) for x in pop))


def apply_array_scaler(df: DataFrame, features: str, scaler: Scaler | None, centre_only: bool = False) -> DataFrame:
    if scaler is None:
        return df
    means = F.array(*[F.lit(m) for m in scaler.means])
    shifted = F.zip_with(F.col(features).cast("array<double>"), means, lambda x, m: x - m)
    if not centre_only:
        stds = F.array(*[F.lit(s or 1.0) for s in scaler.stds])
        shifted = F.zip_with(shifted, stds, lambda x, s: x / s)
    return df.withColumn(features, shifted)


@dataclass(frozen=True)
class Projection:
    rows: DataFrame
    explained: tuple[float, ...]


def pca(df: DataFrame, features: str, k: int = 2, standardise: bool = True) -> Projection:
    """First k principal components of an array column, as ``pc1`` .. ``pck``.

    Missing cells count as 0. Each component's sign is fixed by making its
    largest loading positive.
    """
    filled = df.withColumn(
        features,
        F.transform(F.col(features).cast("array<double>"), lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x)),
    )
    centred = apply_array_scaler(filled, features, fit_array_scaler(filled, features), centre_only=not standardise)
    vectors = centred.withColumn("__vec", array_to_vector(features))
    model = PCA(k=k, inputCol="__vec", outputCol="__pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    pcs = vector_to_array("__pc")
    rows = model.transform(vectors).select(
        *[c for c in df.columns if c != features],
        *[(pcs[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)],
    )
    return Projection(rows, tuple(float(v) for v in model.explainedVariance.toArray()))


def token_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by a blank.

    Built by zipping shifted copies: a lambda that reached back into the whole
    token list would extract it again for every token.
    """
    grams = tokens
    for k in range(2, n + 1):
        count = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count), F.slice(tokens, F.lit(k), count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return grams


def _with_ngrams(df: DataFrame, col: str, sizes: Sequence[int]) -> DataFrame:
    """Add ``__grams``; the tokens get a projection of their own, so they are extracted once."""
    tokens = F.coalesce(words(col), F.array().cast("array<string>"))
    grams = F.flatten(F.array(*[token_ngrams(F.col("__tokens"), n) for n in sizes]))
    return df.withColumn("__tokens", tokens).withColumn("__grams", grams).drop("__tokens")


def fingerprint(
    df: DataFrame, col: str, out: str = "bits", n_bits: int = N_BITS, sizes: Sequence[int] = (1, 2)
) -> DataFrame:
    """Sorted positions of the set bits of a hashed n-gram fingerprint; no tokens, no bits."""
    bit = lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint"), F.lit(n_bits))
    bits = F.array_sort(F.array_distinct(F.transform(F.array_distinct("__grams"), bit)))
    return _with_ngrams(df, col, sizes).withColumn(out, bits).drop("__grams")


def fingerprint_vector(
    df: DataFrame, col: str, out: str = "features", n_bits: int = N_BITS, sizes: Sequence[int] = (1, 2)
) -> DataFrame:
    """The same idea as a sparse 0/1 vector for Spark ML."""
    tf = HashingTF(numFeatures=n_bits, binary=True, inputCol="__grams", outputCol=out)
    return tf.transform(_with_ngrams(df, col, sizes)).drop("__grams")


def lexical_features(col: Column | str) -> dict[str, Column]:
    """Default featuriser: counts over the characters and tokens of a key."""
    c = F.col(col) if isinstance(col, str) else col

    def hits(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    return {
        "n_chars": F.length(c).cast("double"),
        "n_upper": hits("[A-Z]"),
        "n_lower": hits("[a-z]"),
        "n_digit": hits("[0-9]"),
        "n_punct": hits(r"[.,;:!?()=#@+\-]"),
        "n_tokens": hits("[A-Za-z]+"),
        "n_lines": (hits("\n") + 1.0),
    }


def featurize(
    df: DataFrame,
    key: str,
    fn: Callable[[pd.Series], pd.DataFrame] | None = None,
    names: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Key to a wide numeric row, with ``keep`` columns in front and a ``failed`` flag.

    Without ``fn`` the lexical counts are used, in SQL. A user featuriser gets a
    batch of keys and returns one row per key with the columns ``names``; if it
    raises, the batch is retried key by key so that one bad key costs one row.
    """
    if fn is None:
        feats = lexical_features(F.col(key))
        return df.select(*keep, *[e.alias(n) for n, e in feats.items()], F.col(key).isNull().alias("failed"))

    out_fields = [df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    schema = T.StructType(out_fields + [T.StructField("failed", T.BooleanType())])

    def rows_of(keys: pd.Series) -> pd.DataFrame:
        try:
            made = fn(keys).reset_index(drop=True)[list(names)].astype("float64")
            made["failed"] = made.isna().all(axis=1)
            return made
        except Exception:
            if len(keys) > 1:
                return pd.concat([rows_of(keys.iloc[i : i + 1]) for i in range(len(keys))], ignore_index=True)
            return pd.DataFrame({**{n: [None] for n in names}, "failed": [True]}).astype({n: "float64" for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.freeze()
        for pdf in batches:
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), rows_of(pdf[key])], axis=1)
            del pdf
            # A function may leave cycles, as pandas' accessors do: each would keep its batch to the end of the task.
            gc.collect()
        gc.unfreeze()
        release_memory()

    # Batches of bounded bytes: how long the keys are must not decide what a worker holds.
    bound_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, key])).mapInPandas(run, schema)


def element_screen(
    df: DataFrame, col: str, banned: Sequence[str], tokens: Callable[[str], Column] = element_tokens
) -> DataFrame:
    """Drop rows whose token set meets the banned list."""
    return df.filter(~F.coalesce(names_any(tokens(col), banned), F.lit(False)))


def keep_largest_part(df: DataFrame, col: str, sep: str = ".", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, largest_part(col, sep))


def canonicalize(
    df: DataFrame, col: str, out: str = "canonical_key", fn: Callable[[Column], Column] = normalise_key
) -> DataFrame:
    """Canonical key per row; rows whose key cannot be normalised are dropped."""
    return df.withColumn(out, fn(F.col(col))).filter(F.col(out).isNotNull())


def note_failures(df: DataFrame, key: str, comments: str, note: str = "|error of generating inchi") -> DataFrame:
    """Keep the rows without a key and append a note to their comments instead."""
    failed = F.concat(F.coalesce(F.col(comments), F.lit("")), F.lit(note))
    return df.withColumn(comments, F.when(F.col(key).isNull(), failed).otherwise(F.col(comments)))
