"""NaN and the infinities are missing values: in filters, coercion, consensus, scaling and votes."""

import pytest
from pyspark.sql import functions as F

from permeon.functions.cleaning import coerce_number
from permeon.functions.text import clean_text, normalise_key, strip
from permeon.operators.aggregates import nunique_by
from permeon.operators.consensus import numeric_consensus
from permeon.operators.distribution import histogram
from permeon.operators.features import fit_scaler
from permeon.operators.filters import filter_range, property_search
from permeon.operators.scoring import ensemble_mean
from permeon.sources.store import ResultStore

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 5.0), (2, NAN), (3, None), (4, -1.0), (5, INF)], "id int, v double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_nan_passes_no_bound(numbers):
    assert ids(filter_range(numbers, "v", lo=0)) == [1, 5]
    assert ids(filter_range(numbers, "v", hi=10)) == [1, 4]
    assert ids(filter_range(numbers, "v", lo=0, keep_null=True)) == [1, 2, 3, 5]
    assert ids(property_search(numbers, {}, min_confidence=("v", 0.0))) == [1, 5]
    assert ids(filter_range(numbers, "id", lo=4)) == [4, 5]


def test_coercion_fills_nan(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(coerce_number("s")).collect()] == [1.5, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(coerce_number("s", None)).collect()] == [1.5, None, None, None]


def test_consensus_and_scaler_skip_nan(spark, numbers):
    rows = spark.createDataFrame([("a", 1.0), ("a", NAN), ("b", NAN), ("a", INF), ("a", None)], "k string, v double")
    assert [(r["k"], r["value"], r["n"]) for r in numeric_consensus(rows, ["k"], "v").collect()] == [("a", 1.0, 1)]
    scaler = fit_scaler(numbers, ["v"])
    assert scaler.means == (2.0,) and scaler.stds == (3.0,)


def test_distinct_counts_keep_keys_without_values(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), (None, 2)], "k string, v int")
    assert {r["k"]: r["n_values"] for r in nunique_by(rows, "k", "v").collect()} == {"a": 1, "b": 0, None: 1}


def test_a_model_without_probability_takes_no_part(spark):
    rows = spark.createDataFrame([(1, "A", 1, 0.9), (1, "B", 0, None), (2, "A", 0, None)], "id int, model string, pred int, p1 double")
    (row,) = ensemble_mean(rows, "id").collect()
    assert row["id"] == 1 and row["num_models"] == 1 and row["agreement"] == 100.0


def test_discrete_histogram_has_empty_bins(spark):
    rows = spark.createDataFrame([(1.0,), (1.2,), (4.0,), (NAN,)], "x double")
    assert [(r["bin"], r["n"]) for r in histogram(rows, "x", discrete=True).orderBy("bin").collect()] == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_unicode_blanks(spark):
    df = spark.createDataFrame([(" a  b 　",)], "s string")
    assert df.select(strip("s"), clean_text("s"), normalise_key("s")).first()[:] == ("a  b", "a b", "a b")


def test_store_spreads_a_bucket_and_knows_only_missing_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("permeon.sources.store.ROWS_PER_TASK", 50)
    batch = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    store = ResultStore(spark, str(tmp_path / "s"), batch.schema, "key", buckets=2)
    store.insert(batch, ["key"])
    store.insert(batch.union(spark.range(1000, 1010).select("id", "id")), ["key"])
    assert store.read().count() == 1010 and store.read().select("key").distinct().count() == 1010
    assert len(list((tmp_path / "s").glob("data/*/*/*.parquet"))) > 6
    assert ResultStore(spark, str(tmp_path / "none"), batch.schema, "key").read().count() == 0
    (tmp_path / "s" / "manifests" / "000000000003.json").write_text("{")
    with pytest.raises(ValueError):
        store.read()
