"""Sources, sinks, relational operators, filters and the keyed store."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.operators import dedup, filters, joins, projection, sets
from permeon.operators.aggregates import count_incomplete_rows, null_profile
from permeon.sources.columns import as_batch_input, resolve_columns
from permeon.sources.delimited import read_delimited, write_delimited
from permeon.sources.lines import json_records, read_lines, split_lines, write_lines
from permeon.sources.multi import read_sources
from permeon.sources.store import ResultStore, append_aligned, insert_if_absent, process_resumable


def test_tsv_with_repeated_header_and_none(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write('id\tname\tid\n1\tNone\t7\n2\t"a ""b""\tc"\t\n')
    df = read_delimited(spark, str(path), sep="\t", partitions=3)
    assert df.columns == ["id", "name", "id.1"] and df.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in df.collect()) == [(1, None, 7), (2, 'a "b"\tc', None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'say "x"', None)], "i int, s string, d double")
    write_delimited(df, str(tmp_path / "c"))
    assert read_delimited(spark, str(tmp_path / "c"), schema=df.schema).exceptAll(df).count() == 0


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1), (None, 2), ("k3", None)], "k string, i int")
    write_lines(df, ["k", "i"], str(tmp_path / "l"))
    assert sorted(r[0] for r in read_lines(spark, str(tmp_path / "l")).collect()) == ["k1\t1", "k3"]
    text = spark.createDataFrame([(1, " a \n\n\t\nb")], "i int, t string")
    assert [tuple(r) for r in split_lines(text, "t").collect()] == [(1, 0, "a"), (1, 3, "b")]
    assert [r[0] for r in json_records(df.filter("i = 2")).collect()] == ['{"k":null,"i":2}']


def test_sources_are_tagged(spark, tmp_path):
    for n in (2, 10):
        spark.createDataFrame([(f"v{n}",)], "v string").write.json(str(tmp_path / f"R{n}"))
    got = read_sources(spark, [str(tmp_path / "R2"), str(tmp_path / "R10")], T.StructType([T.StructField("v", T.StringType())]))
    assert [tuple(r) for r in got.orderBy("source_no").collect()] == [("v2", 2, "R2"), ("v10", 10, "R10")]


def test_column_detection(spark):
    df = spark.createDataFrame([("a", "b", "c")], "Smiles string, NAME string, SMILES2 string")
    found = resolve_columns(df)
    assert (found.key, found.name, found.mode) == ("Smiles", "NAME", "smiles")
    assert as_batch_input(df.select("NAME")).first() == ("b", "b")
    with pytest.raises(ValueError, match="must contain"):
        resolve_columns(df.select("SMILES2"))


STORE = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.IntegerType())])


def test_store_is_idempotent(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), STORE, "key", buckets=4)
    batch = spark.createDataFrame([("a", 2, 2), ("a", 1, 1), ("b", 3, 3)], "key string, v int, o int")
    for _ in range(2):
        store.insert(batch, ["o"])
    store.insert(spark.createDataFrame([("b", 9, 1), ("c", 4, 1)], "key string, v int, o int"), ["o"])
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_insert_and_append(spark):
    target = spark.createDataFrame([("a", 1), (None, 0)], STORE)
    batch = spark.createDataFrame([("b", 2, 5), ("b", 1, 9), ("a", 7, 1), (None, 8, 1)], "key string, o int, v int")
    assert sorted(tuple(r) for r in insert_if_absent(target, batch, "key", ["o"]).filter("key is not null").collect()) == [("a", 1), ("b", 9)]
    new = spark.createDataFrame([("z", "x"), ("a", "y"), (None, "n")], "key string, extra string")
    assert sorted(map(str, append_aligned(target, new, "key").collect())) == sorted(
        ["Row(key='a', v=1)", "Row(key=None, v=0)", "Row(key='z', v=None)"]
    )


def test_resume_retries_failures(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    done = spark.createDataFrame([(0,), (1,)], "k int")
    out = process_resumable(df, done, "k", lambda d: d.withColumn("bad", F.col("k") == 3), "bad")
    assert sorted(r["k"] for r in out.collect()) == [2, 4]


def test_lookup_first_never_multiplies(spark):
    left = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("c", 1, 1)], "k string, o int, v int")
    got = joins.lookup_first(left, right, "k", "v", ["o"])
    assert sorted((r["k"], r["v"]) for r in got.filter("v is not null").collect()) == [("a", 10), ("a", 10)]
    assert got.count() == 3


def test_first_match_keeps_a_null_value(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, o int, v int")
    assert joins.lookup_first(left, right, "k", "v", ["o"]).first()["v"] is None


def test_enrichment(spark):
    df = spark.createDataFrame([("Aspirin", None, None), ("quinidine", None, None), ("x", 5, "old"), ("gone", None, None)], "name string, cid bigint, comments string")
    lookup = spark.createDataFrame(
        [("aspirin", 1, ["ASPIRIN"]), ("aspirin", 2, ["other"]), ("quinidine", 4, ["qd"]), ("quinidine", 3, ["nope"]), ("x", 6, ["x"])],
        "n string, id bigint, syn array<string>",
    )
    got = {r["name"]: (r["cid"], r["comments"]) for r in joins.enrich_identifier(df, lookup, "name", "n", "id", ["id"], "syn").collect()}
    assert got == {
        "Aspirin": (1, None),
        "quinidine": (3, "More than one CID available for quinidine"),
        "x": (5, "old"),
        "gone": (None, None),
    }


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", None, "z"), ("c", 3, "w"), ("c", 3, "v"), ("c", 1, None), (None, 1, "n")], "k string, o int, v string")
    first = {r["k"]: r["v"] for r in dedup.dedup_first(df, ["k"], ["o", "v"]).collect()}
    assert first == {"a": "x", "b": "y", "c": None, None: "n"}
    assert {r["k"] for r in dedup.dedup_none(df, ["k"]).collect()} == {"a", None}
    assert dedup.count_duplicates(df, ["k"]).first()[0] == 3
    assert dedup.count_duplicates(df.limit(0), ["k"]).first()[0] == 0


def test_sorts_and_top_k(spark):
    df = spark.createDataFrame([("m_10", 1.0), ("m_2", None), ("m_1", 3.0)], "id string, s double")
    assert [r["id"] for r in dedup.natural_sort(df, "id").collect()] == ["m_1", "m_2", "m_10"]
    assert [r["id"] for r in dedup.order_rows(df, ["s"], [False]).collect()] == ["m_1", "m_10", "m_2"]
    big = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("s"))
    got = [r["id"] for r in dedup.top_k(big, "s", 150, ["id"]).collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 10), i))[:150]


def test_filters(spark):
    df = spark.createDataFrame([(1, -9.0), (2, -8.9), (3, None)], "id int, v double")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.filter_range(df, "v", lo=-9, lo_inclusive=False)) == [2]
    assert ids(filters.filter_range(df, "v", lo=-9)) == [1, 2]
    assert ids(filters.filter_range(df, "v", lo=-9, lo_inclusive=False, keep_null=True)) == [2, 3]
    f = spark.createDataFrame([(1, "Success", "BBB+"), (2, "Error", None), (3, "Success", "BBB-")], "id int, status string, prediction string")
    assert ids(filters.facet_filter(f, {"status": ["Success", "Error"], "prediction": ["BBB+", "BBB-"]})) == [1, 3]
    assert ids(filters.facet_filter(f, {"status": ["Error"], "prediction": []})) == [2]
    assert ids(filters.facet_filter(f, {"status": []})) == []
    assert ids(filters.drop_blank(spark.createDataFrame([(1, " \t\n"), (2, "a"), (3, None)], "id int, t string"), "t")) == [2]


def test_feature_contract(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(10))], ", ".join(f"f{i} double" for i in range(10)))
    names = [f"f{i}" for i in range(9)] + ["g"]
    got = projection.align_features(df, names[::-1])
    assert got.columns == names[::-1] and got.first()["g"] == 0.0
    with pytest.raises(projection.FeatureMismatch, match=r"8/10 features present \(80.0%\).*\['g', 'h'\]"):
        projection.align_features(df, names[1:] + ["h"])


def test_null_accounting(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.0, None), (3, 2.0, "b")], "i int, x double, s string")
    assert {r["column"]: r["nulls"] for r in null_profile(df).collect()} == {"i": 0, "x": 1, "s": 1}
    assert count_incomplete_rows(df).first()[0] == 2
    assert projection.prune_columns(df, ["i", "x", "s"], max_nulls=0) == ["i"]
    assert sets.schema_diff(["a", "b"], ["b", "c"]) == {"both": ["b"], "only_a": ["a"], "only_b": ["c"]}
