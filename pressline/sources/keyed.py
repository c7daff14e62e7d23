"""Keyed state in hash buckets: a batch rewrites the buckets that it touches, and a manifest swaps them in.

Below the path lie ``data/<version>/__bucket=<n>`` and ``manifest/<number>.json``.  A manifest names the
epoch that it includes and where each bucket's files are, most of them in older versions; it is
the state.  A batch that fails before its manifest is there has changed nothing, one that was
applied is not applied again, and readers of the manifest before go on reading its files.

A manifest has an entry for each bucket, of which there are as many as the store was made with;
choose so many that a bucket is a task's work (some 100 MB).  Keys are spread by hash; the rows
of a key, and of what is merged with it, are in one bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = 2
_BUCKET = "__bucket"


class KeyedStore:
    """State of rows of a schema by keys; keys may be null, a null being equal to a null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        sc = spark.sparkContext
        self._jvm = sc._jvm
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())
        held = self.manifest()
        self.buckets = held["buckets_in_all"] if held else buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifest/{number:012}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        numbers = self._numbers()
        return self._read_manifest(numbers[-1]) if numbers else None

    def _write_manifest(self, number: int, content: dict) -> None:
        draft, final = (self._path(f"{self.path}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"{number:012}.json"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has made manifest {number} of {self.path}")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The state, or that of some buckets."""
        held = self.manifest()
        where = held["where"] if held else {}
        paths = [p for b, p in sorted(where.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in set(buckets)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of rows: numbers, at most as many as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def apply(self, batch: DataFrame, epoch: int, merge: Callable[[DataFrame, DataFrame], DataFrame], *, every: bool = False) -> dict | None:
        """state = merge(state of the touched buckets, batch), unless the epoch was applied already.

        merge returns all rows that stay of the buckets' keys and may add keys of the batch
        alone.  every: merge sees the whole state, for batches that also tell by what they lack.
        Gives the new manifest; None for an epoch that is in it already.
        """
        held = self.manifest() or {"number": 0, "epoch": -1, "where": {}, "buckets_in_all": self.buckets}
        if epoch <= held["epoch"]:
            return None
        wanted = list(range(self.buckets)) if every else self.touched(batch)
        version = f"data/{epoch:012}-{uuid.uuid4().hex[:8]}"
        merged = merge(self.read(wanted), batch).withColumn(_BUCKET, self.bucket())
        names = [c for c in merged.columns if c != _BUCKET]
        ordered = self.spark.createDataFrame([], self.schema).columns
        if sorted(names) != sorted(ordered):
            raise ValueError(f"merge gave {names}, the state has {ordered}")
        merged.select(*ordered, _BUCKET).repartition(max(1, len(wanted)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{version}")
        found = {}
        root = self._path(f"{self.path}/{version}")
        for status in self._fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(_BUCKET + "="):
                found[name.partition("=")[2]] = f"{version}/{name}"
        strange = {int(b) for b in found} - set(wanted)
        if strange:
            raise ValueError(f"merge gave keys of buckets that the batch does not touch: {sorted(strange)}")
        where = {b: p for b, p in held["where"].items() if int(b) not in set(wanted)} | found
        new = {"number": held["number"] + 1, "epoch": epoch, "where": where, "buckets_in_all": self.buckets, "rewritten": len(wanted), "bytes_written": self._fs.getContentSummary(root).getLength()}
        self._write_manifest(new["number"], new)
        self._clean()
        return new

    def _clean(self) -> None:
        """Drop manifests but the newest KEPT, and versions that none of these names."""
        numbers = self._numbers()
        named = {p.split("/")[1] for n in numbers[-KEPT:] for p in self._read_manifest(n)["where"].values()}
        for status in self._fs.listStatus(self._path(f"{self.path}/data")):
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
        for n in numbers[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/manifest/{n:012}.json"), False)


def latest(keys: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the last row of each key by order (of equal ones the batch's)."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        both = old.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("__new").desc()))
        return both.withColumn("__n", place).filter("__n = 1").drop("__n", "__new")

    return merge


def first(keys: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that inserts keys that are not stored (the first row by order) and leaves stored ones as they are."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        fresh = batch.withColumn("__n", place).filter("__n = 1").drop("__n")
        fresh = fresh.join(old.select(*keys), keys, "left_anti")
        return old.unionByName(fresh.select(*old.columns))

    return merge


def run(stream: DataFrame, store: KeyedStore, checkpoint: str, merge, *, every: bool = False):
    """Apply all available batches of a stream to a store; a batch that is replayed after its manifest was written changes nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, epoch: store.apply(batch, epoch, merge, every=every) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
