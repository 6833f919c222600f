"""Records that differ only in how they are written, counted once each across batches.

The ledger is a table of canonical keys in hash buckets: key, number of copies, earliest row. A new
batch is aggregated first (counts are combined before the shuffle, so a key that holds a third of
the rows costs no more than any other), then full-outer-joined with the ledger's rows bucket by
bucket; counts are added and the earliest representative stays. The ledger's side of the join is read
in its buckets, without a shuffle.

It has two levels, so that a small batch does not rewrite everything: batches are joined into the
delta, and the delta into the base once it has grown to a ``COMPACT``-th of it. New versions are written
beside the old ones, and a manifest with the next number, put in place by one rename, makes them
valid: a run that dies at any point leaves the ledger as it was, and one that comes back finds in the
manifest which batches are in. The versions of the manifest before stay for readers.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.session import cut, remove, salted_join, scratch

#: The delta goes into the base when it has more than a COMPACT-th of its keys.
COMPACT = 10


def label_key(label: Column) -> Column:
    """Letters and digits without case; a run of other characters between two digits is one mark."""
    mark = "\u0001"
    plain = F.regexp_replace(F.lower(label), mark, " ")
    marked = F.regexp_replace(plain, r"(?<=\p{N})[^\p{L}\p{N}]+(?=\p{N})", mark)
    return F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{mark}]", "")


def object_key(text: Column) -> Column:
    """A JSON object by its keys and values: members in order of their keys, no optional white space.

    Null stays null; text that is no JSON is compared as it is.
    """
    return F.when(text.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("\u0001"), text)))


def digest(*parts: Column) -> Column:
    """A 256-bit digest that tells null from empty and where a part ends."""
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


class Ledger:
    """Bucketed counts of canonical keys at a path that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("buckets", buckets)  # an existing ledger keeps its own

    def _names(self, folder: str, pattern: str) -> list[int]:
        root = self._path(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(m[1]) for m in (re.fullmatch(pattern, n) for n in names) if m)

    def manifest(self, back: int = 0) -> dict:
        """What is valid now: the versions of both levels, their keys, the batches that are in."""
        numbers = self._names(self.path, r"manifest-(\d+)\.json")
        if len(numbers) <= back:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{numbers[-1 - back]:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        number = manifest["number"]
        part = self._path(f"{self.path}/new-{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        target = self._path(f"{self.path}/manifest-{number:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            raise RuntimeError(f"another writer has put manifest {number} in place")

    def _level(self, version: int | None) -> DataFrame | None:
        """One version as a table that Spark knows the buckets of."""
        if version is None:
            return None
        folder = f"{self.path}/rows/version={version}"
        name = f"ledger_{md5(folder.encode()).hexdigest()}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key BINARY, copies BIGINT, keep_row_id BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> int:
        version = max(self._names(f"{self.path}/rows", r"version=(\d+)"), default=0) + 1  # also past those of runs that died
        folder = f"{self.path}/rows/version={version}"
        name = f"ledger_{md5(folder.encode()).hexdigest()}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", folder).saveAsTable(name)
        return version

    def _joined(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Two tables of keys as one: counts added, the earliest row kept."""
        if old is None:
            return new.repartition(self.buckets, "key")
        late = new.select("key", F.col("copies").alias("more"), F.col("keep_row_id").alias("other"))
        return old.join(late, "key", "full_outer").select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("copies"), F.least("keep_row_id", "other").alias("keep_row_id"))

    def read(self) -> DataFrame:
        """``(key, copies, keep_row_id)``."""
        now = self.manifest()
        base, delta = self._level(now.get("base")), self._level(now.get("delta"))
        if base is None:
            return self.spark.createDataFrame([], "key binary, copies bigint, keep_row_id bigint")
        return base if delta is None else self._joined(base, delta)

    def merge(self, batch: DataFrame, batch_id: str | None = None) -> bool:
        """Add a batch ``(key, row_id)``; False if a batch of that id is in already. An empty batch adds nothing."""
        now = self.manifest()
        if batch_id is not None and batch_id in now.get("batches", []):
            return False
        after = {"number": now.get("number", 0) + 1, "buckets": self.buckets, "base": now.get("base"), "delta": now.get("delta"), "batches": now.get("batches", []) + ([batch_id] if batch_id is not None else [])}
        if batch.limit(1).count():
            new = batch.groupBy("key").agg(F.count("*").alias("copies"), F.min("row_id").alias("keep_row_id"))
            if after["base"] is None:
                after["base"] = self._write(self._joined(None, new))
            else:
                after["delta"] = self._write(self._joined(self._level(after["delta"]), new))
                if self._level(after["delta"]).count() * COMPACT > self._level(after["base"]).count():
                    after["base"], after["delta"] = self._write(self._joined(self._level(after["base"]), self._level(after["delta"]))), None
        self._publish(after)
        self._tidy(after, now)
        return True

    def _tidy(self, *manifests: dict) -> None:
        live = {m.get(level) for m in manifests for level in ("base", "delta")}
        for v in self._names(f"{self.path}/rows", r"version=(\d+)"):
            if v not in live:
                folder = f"{self.path}/rows/version={v}"
                self.spark.sql(f"DROP TABLE IF EXISTS ledger_{md5(folder.encode()).hexdigest()}")
                remove(self.spark, folder)
        for n in self._names(self.path, r"manifest-(\d+)\.json")[:-2]:
            remove(self.spark, f"{self.path}/manifest-{n:09d}.json")

    def drop(self) -> None:
        """Delete the ledger with its files."""
        for v in self._names(f"{self.path}/rows", r"version=(\d+)"):
            self.spark.sql(f"DROP TABLE IF EXISTS ledger_{md5(f'{self.path}/rows/version={v}'.encode()).hexdigest()}")
        remove(self.spark, self.path)


def triple_keys(kg: DataFrame) -> DataFrame:
    """``(row_id, key)`` of the rows of kg_inferred with three labels that are not null."""
    labels = [F.col(f"{x}.label") for x in ("subject", "predicate", "object")]
    rows = kg.where(labels[0].isNotNull() & labels[1].isNotNull() & labels[2].isNotNull())
    return rows.select("row_id", digest(F.col("doc_id").cast("string"), *[label_key(x) for x in labels], object_key(F.col("metadata"))).alias("key"))


def build_ledger(keys: DataFrame, batches: int = 2, path: str | None = None, buckets: int | None = None) -> Ledger:
    """A ledger of ``keys(row_id, key)``, merged in batches in order of arrival.

    Unless ``buckets`` is given there are as many as partitions of a shuffle, so that a batch is shuffled once.
    """
    spark = keys.sparkSession
    ledger = Ledger(spark, path or scratch(spark, "ledger"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, high = keys.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return ledger
    step = (high - low) // batches + 1
    for i in range(batches):
        ledger.merge(keys.where((F.col("row_id") >= low + i * step) & (F.col("row_id") < low + (i + 1) * step)), f"{i + 1} of {batches}")
    return ledger


def groups_of(keys: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """The ledger's keys with two copies or more, as ``(key, keep_row_id)`` and as ``(key, n)``."""
    groups = build_ledger(keys, batches).read().where("copies > 1")
    return groups.select("key", "keep_row_id"), groups.select("key", F.col("copies").alias("n"))


def copies(kg: DataFrame, batches: int = 2) -> DataFrame:
    """``(keep_row_id, copy_row_id)``: every row that repeats an earlier one, with the earliest of its group.

    The rows join the ledger's keys that have copies; hot keys are salted, as one may hold a
    third of all rows. Rows with a null label belong to no group.
    """
    keys = cut(triple_keys(kg))  # read by every batch and by the join
    groups, counts = groups_of(keys, batches)
    joined = salted_join(keys, groups, ["key"], F.col("row_id"), counts)
    return joined.where("row_id <> keep_row_id").select("keep_row_id", F.col("row_id").alias("copy_row_id"))
