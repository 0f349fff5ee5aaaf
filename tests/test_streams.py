"""Streams: restartable, idempotent, and equal to their batch form."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.session import scratch_dir, spread
from permeon.sources.store import ResultStore, insert_if_absent
from permeon.streaming.micro_batch import run_to_end, stream_append, stream_dedup, stream_files, stream_first_rows, stream_score

EVENTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("ts", T.TimestampType())])
STORE = T.StructType([T.StructField("key", T.StringType()), T.StructField("score", T.IntegerType())])


def arrive(spark, folder, rows):
    data = [(k, v, None) for k, v in rows]
    spark.createDataFrame(data, EVENTS).withColumn("ts", F.timestamp_seconds(F.col("v") * 3600)).coalesce(1).write.mode("append").parquet(folder)


def score(df):
    return df.select("key", (F.col("v") * 10).alias("score"), "v")


def test_score_and_insert(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    store = ResultStore(spark, str(tmp_path / "out"), STORE, "key", buckets=4)
    go = lambda: run_to_end(stream_score(stream_files(spark, src, EVENTS), score, store, ["v"], ckpt))
    first, second = [("a", 2), ("a", 1), ("b", 5)], [("b", 0), ("c", 7)]
    arrive(spark, src, first)
    go()
    go()
    arrive(spark, src, second)
    go()
    got = sorted(tuple(r) for r in store.read().collect())
    assert got == [("a", 10), ("b", 50), ("c", 70)]
    batch = spark.createDataFrame([], STORE)
    for rows in (first, second):
        batch = insert_if_absent(batch, score(spark.createDataFrame(rows, "key string, v int")), "key", ["v"])
    assert sorted(tuple(r) for r in batch.collect()) == got


def test_insert_survives_a_lost_checkpoint(spark, tmp_path):
    src = str(tmp_path / "in")
    store = ResultStore(spark, str(tmp_path / "out"), STORE, "key", buckets=4)
    arrive(spark, src, [("a", 1), ("b", 2)])
    for n in range(2):
        run_to_end(stream_score(stream_files(spark, src, EVENTS), score, store, ["v"], str(tmp_path / f"ck{n}")))
    assert store.read().count() == 2


def test_append_resumes(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    go = lambda: run_to_end(stream_append(stream_files(spark, src, EVENTS), lambda d: d.select("key", "v"), out, ckpt))
    arrive(spark, src, [("a", 1)])
    go()
    arrive(spark, src, [("b", 2)])
    go()
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2)]


def test_first_seen(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([("a", 1), ("a", 2)], [("a", 3), ("b", 4)]):
        arrive(spark, src, rows)
        run_to_end(stream_append(stream_files(spark, src, EVENTS), lambda d: stream_dedup(d, "key"), out, ckpt))
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def fake_session(setting, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=SimpleNamespace(master=master))


def test_scratch_follows_the_session():
    assert scratch_dir(fake_session("hdfs://shared/tmp/", "yarn"), "x").startswith("hdfs://shared/tmp/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(fake_session(None, "spark://host:7077"), "x")
    assert os.path.isdir(os.path.dirname(scratch_dir(fake_session(None, "local[2]"), "x")))


def test_spread(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 8
    full = spark.range(100).repartition(9)
    assert spread(full) is full


def test_forgotten_keys_come_again(spark, tmp_path):
    """With a watermark a key is forgotten after the delay, and then counts as new."""
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def go():
        source = stream_files(spark, src, EVENTS)
        run_to_end(stream_append(source, lambda s: stream_dedup(s.select("key", "v", "ts"), "key", "ts", "2 hours"), out, ckpt))
        return sorted((r["key"], r["v"]) for r in spark.read.parquet(out).collect())

    arrive(spark, src, [("a", 1), ("b", 1), ("a", 2)])
    first = go()
    assert [k for k, _ in first] == ["a", "b"]
    arrive(spark, src, [("a", 3)])
    assert go() == first
    arrive(spark, src, [("c", 30)])  # moves the watermark past the delay of all before
    go()
    arrive(spark, src, [("a", 31), ("c", 31)])
    assert sorted(k for k, _ in go()) == ["a", "a", "b", "c"]


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"), STORE, "key", buckets=3)


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, score int, v int")


def contents(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_a_write_killed_before_its_commit_is_not_seen(spark, store, monkeypatch):
    store.insert(batch_of(spark, ("a", 1, 0)), ["v"])
    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda new: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.insert(batch_of(spark, ("a", 9, 0), ("b", 2, 0), ("c", 3, 0)), ["v"])
    assert contents(store) == [("a", 1)]
    monkeypatch.setattr(store, "_commit", commit)
    store.insert(batch_of(spark, ("b", 2, 0), ("c", 3, 0)), ["v"])
    assert contents(store) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.vacuum() > 0 and contents(store) == [("a", 1), ("b", 2), ("c", 3)] and store.vacuum() == 0


def test_a_second_writer_comes_second(spark, store, monkeypatch):
    """Another writer commits between this one's look at the store and its commit."""
    other = ResultStore(spark, store.path, STORE, "key", buckets=3)
    commit, tries = store._commit, []

    def late(new):
        tries.append(new.version)
        if len(tries) == 1:
            other.insert(batch_of(spark, ("a", 7, 0), ("z", 8, 0)), ["v"])
        commit(new)

    monkeypatch.setattr(store, "_commit", late)
    store.insert(batch_of(spark, ("a", 1, 0), ("b", 2, 0)), ["v"])
    assert tries == [1, 2] and contents(store) == [("a", 7), ("b", 2), ("z", 8)]


def test_threads_insert_each_key_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    def work(i):
        mine = ResultStore(spark, store.path, STORE, "key", buckets=3)
        mine.insert(batch_of(spark, *((f"k{k}", i, 0) for k in range(i, i + 6))), ["v"])

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    assert [k for k, _ in contents(store)] == [f"k{k}" for k in range(8)]
    assert store.manifest().version == 3


def test_a_replayed_batch_reads_nothing(spark, store, monkeypatch):
    store.insert(batch_of(spark, ("a", 1, 0)), ["v"], ("s", 0))
    store.insert(batch_of(spark, ("b", 1, 0)), ["v"], ("other", 0))
    monkeypatch.setattr(store, "_rows", lambda files: pytest.fail("the store was read"))
    monkeypatch.setattr(store, "_written", lambda rows: pytest.fail("rows were written"))
    store.insert(SimpleNamespace(), ["v"], ("s", 0))
    monkeypatch.undo()
    store.insert(batch_of(spark, ("a", 5, 0), ("c", 1, 0)), ["v"], ("s", 1))
    assert contents(store) == [("a", 1), ("b", 1), ("c", 1)] and store.manifest().batches == {"s": 1, "other": 0}


def test_compaction_keeps_rows_and_open_readers(spark, store):
    for i in range(5):
        store.insert(batch_of(spark, *((f"k{i}-{k}", i, 0) for k in range(9))), ["v"])
    before, reader = contents(store), store.read()
    files = store.manifest().files
    assert max(map(len, files.values())) == 5
    assert store.compact(2) == len(files) and store.compact(2) == 0
    assert max(map(len, store.manifest().files.values())) == 1 and contents(store) == before
    assert sorted(tuple(r) for r in reader.collect()) == before
    assert store.vacuum() == sum(map(len, files.values())) and contents(store) == before


def test_a_stream_killed_between_write_and_checkpoint_goes_on(spark, tmp_path, store, monkeypatch):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    go = lambda scorer: run_to_end(stream_score(stream_files(spark, src, EVENTS), scorer, store, ["v"], ckpt))
    arrive(spark, src, [("a", 1), ("b", 2)])
    insert = store.insert

    def then_die(*args):
        insert(*args)
        raise RuntimeError("killed after the commit")

    monkeypatch.setattr(store, "insert", then_die)
    with pytest.raises(Exception, match="killed after the commit"):
        go(score)
    monkeypatch.undo()
    monkeypatch.setattr(store, "_rows", lambda files: pytest.fail("the store was read"))
    go(score)
    monkeypatch.undo()
    assert contents(store) == [("a", 10), ("b", 20)] and store.manifest().version == 1
    arrive(spark, src, [("b", 0), ("c", 3)])
    go(score)
    assert contents(store) == [("a", 10), ("b", 20), ("c", 30)]


def test_first_rows_keep_no_state(spark, tmp_path):
    """However many keys there are, the query holds none; a later run still knows them."""
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    store = ResultStore(spark, str(tmp_path / "out"), T.StructType([EVENTS["key"], EVENTS["v"]]), "key", buckets=4)
    sizes = []
    for start in (0, 300):
        arrive(spark, src, [(f"k{i % 400}", 1000 + i) for i in range(start, start + 300)])
        q = stream_first_rows(stream_files(spark, src, EVENTS).select("key", "v"), store, ["v"], ckpt)
        run_to_end(q)
        sizes.append([s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]])
    assert sizes == [[], []]
    assert {r["key"]: r["v"] for r in store.read().collect()} == {f"k{i}": 1000 + i for i in range(400)}
