"""Keyed result store: insert-if-absent, aligned append, resumable append."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permeon.functions.labels import encode_label
from permeon.operators.dedup import dedup_first
from permeon.operators.joins import new_rows
from permeon.operators.projection import align_to


def rows_to_insert(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Batch rows whose key is new; the first in ``order`` wins inside the batch."""
    return new_rows(dedup_first(batch, [key], order), target.select(key), key)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Target with the new keys of the batch below it; an existing key always wins."""
    fresh = rows_to_insert(target, batch, key, order)
    return target.unionByName(align_to(fresh, target.schema))


def append_aligned(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with new keys, cut to the target's columns, below the target.

    Extra columns are dropped and absent ones filled with NULL. Without the key
    column on both sides every row is appended.
    """
    aligned = align_to(new, target.schema)
    if key in target.columns and key in new.columns:
        aligned = new_rows(aligned, target.select(key), key)
    return target.unionByName(aligned)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs not written yet; resuming goes by key, not by row count."""
    return new_rows(df, done.select(key), key)


def process_resumable(
    df: DataFrame, done: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame], failed: str | None = None
) -> DataFrame:
    """Results of ``fn`` for what is still pending.

    ``fn`` must give a row per input and mark trouble in the ``failed`` column;
    such rows are left out, so a later run tries them again.
    """
    out = fn(pending(df, done, key))
    return out.filter(~F.col(failed)).drop(failed) if failed else out


def prediction_record(
    key: Column, name: Column, prediction: Column, info_key: Column | None = None, info_name: Column | None = None
) -> list[Column]:
    """Key, name and 0/1 label of a stored prediction.

    Service-provided key and name come before computed ones; a missing key reads
    ``Unknown`` and a missing name falls back to the key.
    """
    k = F.coalesce(*([info_key] if info_key is not None else []), key, F.lit("Unknown"))
    n = F.coalesce(*([info_name] if info_name is not None else []), name, k)
    return [k.alias("key"), n.alias("name"), encode_label(prediction).alias("prediction")]


#: Rows that one write task takes.
ROWS_PER_TASK = 1_000_000
#: Files of a bucket that :meth:`ResultStore.compact` leaves alone.
FILES_PER_BUCKET = 8


class Conflict(Exception):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Manifest:
    """One version of a store: its files by bucket, and the last batch of each stream that is in it."""

    version: int = 0
    files: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def then(self, files: dict[str, list[str]], batches: dict[str, int]) -> Manifest:
        return Manifest(self.version + 1, files, batches)


class ResultStore:
    """Parquet files whose rows are unique on ``key``, under a manifest.

    Readers see the files that the newest manifest lists and no others, so a write
    that fails or is killed half-way leaves nothing visible. A writer commits by
    creating the next version's manifest, which only one can; the one that comes
    second looks at the new version and inserts what is still missing. So keys stay
    unique with any number of writers.

    Rows lie in ``buckets`` by key hash, and an insert reads only the files of the
    buckets its own keys fall into. A batch of a stream is entered in the manifest
    with its rows: replayed, it returns before it reads anything.

    The manifest is one object whose size goes with the number of files, which
    :meth:`compact` keeps small. Creating a file that exists must fail on the storage
    used, as it does on HDFS and local disks.
    """

    BUCKET = "key_bucket"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    # ---- files

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, folder: str) -> list[str]:
        """Paths of the files below a folder, relative to it."""
        fs, at = self._hadoop(folder)
        if not fs.exists(at):
            return []
        root, out, found = fs.makeQualified(at).toString().rstrip("/"), [], fs.listFiles(at, True)
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(root).lstrip("/"))
        return sorted(out)

    def manifest(self) -> Manifest:
        """The newest version."""
        names = [n for n in self._listed(f"{self.path}/manifests") if re.fullmatch(r"\d{12}\.json", n)]
        if not names:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> None:
        """Creates the manifest of the next version; raises Conflict if there is one."""
        jvm = self.spark._jvm
        fs, at = self._hadoop(f"{self.path}/manifests/{new.version:012d}.json")
        _, draft = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        # The draft is complete before it gets its name, and a name is given once.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = plain
        try:
            context.rename(draft, at, options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.toString():
                raise Conflict(new.version) from None
            raise

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows with a bucket column to a folder of their own; its files by bucket."""
        folder = f"batch={uuid.uuid4().hex}"
        rows.write.partitionBy(self.BUCKET).parquet(f"{self.path}/data/{folder}")
        out: dict[str, list[str]] = {}
        for name in self._listed(f"{self.path}/data/{folder}"):
            bucket = re.match(rf"{self.BUCKET}=(\d+)/[^_.].*\.parquet$", name)
            if bucket:
                out.setdefault(bucket[1], []).append(f"{folder}/{name}")
        return out

    def _rows(self, files: Sequence[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.BUCKET, T.IntegerType())])
        if not files:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{f}" for f in files]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    # ---- rows

    def read(self) -> DataFrame:
        """The rows of the newest version; later inserts do not change the frame."""
        return self._rows([f for own in self.manifest().files.values() for f in own]).drop(self.BUCKET)

    def insert(self, batch: DataFrame, order: Sequence[str], stream: tuple[str, int] | None = None) -> None:
        """Add the rows with new keys; the first in ``order`` wins inside the batch.

        ``stream`` names the stream and the batch that the rows are.
        """
        now = self.manifest()
        if stream and now.batches.get(stream[0], -1) >= stream[1]:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        first = dedup_first(batch, [self.key], order).withColumn(self.BUCKET, bucket).persist()
        try:
            sizes = first.groupBy(self.BUCKET).count().collect()
            while True:
                try:
                    self._commit(self._with(now, first, sizes, stream))
                    return
                except Conflict:
                    now = self.manifest()
                    if stream and now.batches.get(stream[0], -1) >= stream[1]:
                        return
        finally:
            first.unpersist()

    def _with(self, now: Manifest, first: DataFrame, sizes: Sequence[Row], stream: tuple[str, int] | None) -> Manifest:
        """The version after ``now`` that has the new rows; these are written, but not yet listed."""
        touched, rows = [r[0] for r in sizes], sum(r[1] for r in sizes)
        batches = now.batches | ({stream[0]: stream[1]} if stream else {})
        if not touched:
            return now.then(now.files, batches)
        known = self._rows([f for b in touched for f in now.files.get(str(b), [])]).select(F.col(self.key).alias("__key"), F.col(self.BUCKET).alias("__bucket"))
        same = (first[self.BUCKET] == F.col("__bucket")) & first[self.key].eqNullSafe(F.col("__key"))
        fresh = first.join(known, same, "left_anti")
        aligned = align_to(fresh, T.StructType([*self.schema.fields, T.StructField(self.BUCKET, T.IntegerType())]))
        # Each bucket goes to as many tasks as its share of the batch needs, by key, so no task gets a whole hot bucket.
        salts = max(1, -(-rows // (ROWS_PER_TASK * len(touched))))
        salt = F.pmod(F.xxhash64(F.lit("salt"), self.key), F.lit(salts))
        written = self._written(aligned.repartition(len(touched) * salts, self.BUCKET, salt))
        return now.then({b: now.files.get(b, []) + written.get(b, []) for b in now.files | written}, batches)

    def compact(self, files: int = FILES_PER_BUCKET) -> int:
        """Rewrites buckets of more than ``files`` files as one file for each ROWS_PER_TASK rows; how many buckets.

        Files that are no longer listed stay on disk for readers of older versions until :meth:`vacuum`.
        """
        while True:
            now = self.manifest()
            many = [b for b, own in now.files.items() if len(own) > files]
            if not many:
                return 0
            rows = self._rows([f for b in many for f in now.files[b]])
            largest = max((r[1] for r in rows.groupBy(self.BUCKET).count().collect()), default=1)
            salts = max(1, -(-largest // ROWS_PER_TASK))
            salt = F.pmod(F.xxhash64(F.lit("salt"), self.key), F.lit(salts))
            written = self._written(rows.repartition(len(many) * salts, self.BUCKET, salt))
            try:
                self._commit(now.then({b: written.get(b, []) if b in many else own for b, own in now.files.items()}, now.batches))
                return len(many)
            except Conflict:
                continue

    def vacuum(self) -> int:
        """Deletes data files that the newest version does not list; how many. Not while writers or older readers are at work."""
        listed = {f for own in self.manifest().files.values() for f in own}
        gone = [f for f in self._listed(f"{self.path}/data") if f not in listed]
        for f in gone:
            fs, at = self._hadoop(f"{self.path}/data/{f}")
            fs.delete(at, False)
        return len([f for f in gone if f.endswith(".parquet")])
