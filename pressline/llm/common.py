"""Shared plumbing of the training-data operators: work folders, staging and word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not inherit the driver's path."""
    sc = spark.sparkContext
    if _ROOT in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == _ROOT or getattr(sc, "_pressline_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "pressline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "pressline")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
    sc._pressline_shipped = True


class Workspace:
    """A folder of one operator call below ``spark.checkpoint.dir``.

    Everything that has to outlive a stage is written there, so a lost executor costs a
    re-read and never a recomputation from the start.  Hadoop deletes the folder when the
    driver ends.  Where the setting is missing, a local master gets a temporary folder and
    a cluster gets an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        sc = spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = getattr(sc, "_pressline_tmp", None)
            if base is None:
                base = sc._pressline_tmp = "file://" + tempfile.mkdtemp(prefix="pressline-")
        self.path = f"{base.rstrip('/')}/pressline/{name}-{uuid.uuid4().hex}"
        hpath = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hpath)
        ship(spark)

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: the lineage ends there and its size is known to the planner."""
        target = self.sub(name)
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        hpath = sc._jvm.org.apache.hadoop.fs.Path(self.sub(name))
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


class Sieve:
    """Bits of the hashes of a column of ids: rows whose id is not among them pass by without a shuffle.

    The bitmaps take at most MAX_BITS bits (64 MB), whatever the number of ids, so they may be
    broadcast.  With more ids than bits the sieve holds ever more of the others too, which then
    take part in the exact join that has to follow.
    """

    MAX_BITS = 1 << 29

    def __init__(self, workspace: Workspace, ids: DataFrame, name: str):
        """ids: a staged frame of one column."""
        n, self.bits = ids.count(), 1 << 15
        while self.bits < 16 * n and self.bits < self.MAX_BITS:
            self.bits *= 2
        place = self._place(F.col(ids.columns[0]))
        maps = ids.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("bit"))
        self.maps = workspace.stage(maps.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits")), name)

    def _place(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def mark(self, df: DataFrame, column: str) -> DataFrame:
        """df with __held: may the row's id be among the ids?"""
        place = self._place(F.col(column))
        at = F.bitmap_bit_position(place)
        joined = df.withColumn("__at", F.bitmap_bucket_number(place)).join(F.broadcast(self.maps), F.col("__at") == F.col("__bucket"), "left")
        byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        power = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))
        held = F.col(column).isNotNull() & F.coalesce(F.floor(byte / power) % 2 == 1, F.lit(False))
        return joined.withColumn("__held", held).drop("__at", "__bucket", "__bits")


class WordHash(dict):
    """word -> 64-bit hash; frequent words are looked up, the table is emptied when it is full."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; the whole sequence as one run where it is shorter."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    acc = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        acc = acc * _ODD[7] + word_hashes[i : n - k + 1 + i] * _ODD[i % 7]
        acc ^= acc >> _S31
    return mix64(acc)
