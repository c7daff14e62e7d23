"""File sinks: quoted CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Cells with commas, quotes or line ends are quoted, quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


GAP_COLUMNS = ("ticker", "company_name", "country", "resolution_status", "gap_reason", "also_covered_as", "note")


def write_gaps(gaps: DataFrame, path: str) -> None:
    """The coverage gaps as CSV, by reason and ticker."""
    held = [F.col(c) if c in gaps.columns else F.lit(None).cast("string").alias(c) for c in GAP_COLUMNS]
    write_csv(gaps.select(*held).orderBy("gap_reason", "ticker"), path)


def _versions(spark, state_path: str):
    """The file system, the root and the numbers of the whole versions below state_path, oldest first."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    root = path(state_path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, root, []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return fs, root, sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(path(root, n), "_SUCCESS")))


def upsert_batches(state_path: str, merge, keep: int = 2):
    """A foreachBatch function: state = merge(state, batch), written beside and then swapped in by version.

    For states of bounded size (current rows by key); what grows with the stream is kept as state
    of a stateful operator instead.  A batch that was already applied is skipped, so a replay
    after a failure changes nothing.  The newest ``keep`` versions stay, for readers at work.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, root, done = _versions(spark, state_path)
        if epoch in done:
            return
        before = [v for v in done if v < epoch]
        old = spark.read.parquet(f"{state_path}/v{before[-1]}") if before else None
        merge(old, batch).write.mode("overwrite").parquet(f"{state_path}/v{epoch}")
        for v in [*before, epoch][:-keep]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"v{v}"), True)

    return apply


def latest_state(spark, state_path: str) -> DataFrame | None:
    """The newest whole version of a state that upsert_batches wrote; unfinished ones don't count."""
    done = _versions(spark, state_path)[2]
    return spark.read.parquet(f"{state_path}/v{done[-1]}") if done else None
