"""The state transitions under Structured Streaming.

Batches go through the same functions as in :mod:`pressline.operators.state`; a test holds
the two against each other.  Offsets, leases and bounded batches are the checkpoint's and the
trigger's: a batch that fails is replayed, and replays change nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressline.operators import state
from pressline.sources.sinks import upsert_batches

OVERLAP = "6 hours"


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, a bounded number of them in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def deduplicated(events: DataFrame, key: str, ts: str, overlap: str = OVERLAP) -> DataFrame:
    """Late and repeated deliveries inside the overlap are absorbed; state older than it is dropped."""
    return events.withWatermark(ts, overlap).dropDuplicatesWithinWatermark([key])


def velocity(events: DataFrame, key: str, ts: str, window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Events per key in sliding windows."""
    return events.withWatermark(ts, OVERLAP).groupBy(F.window(ts, window, slide), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n")


FETCH_OUT = "company_id long, provider string, consecutive_failures int, last_success_at timestamp, last_article_at timestamp, suppressed_until timestamp"
FETCH_STATE = "failures int, success timestamp, newest timestamp"


def _fold_fetches(key, frames, kept: GroupState):
    failures, success, newest = kept.get if kept.exists else (0, None, None)
    until = None
    for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
        if r.ok:
            failures, success, until = 0, r.at, None
            if not pd.isna(r.newest) and (newest is None or r.newest > newest):
                newest = r.newest
        else:
            failures += 1
            until = r.at + pd.Timedelta(hours=state.SUPPRESS_HOURS) if failures >= state.FAILURES_TO_SUPPRESS else None
    kept.update((failures, success, newest))
    yield pd.DataFrame({"company_id": [key[0]], "provider": [key[1]], "consecutive_failures": pd.array([failures], "int32"), "last_success_at": [success], "last_article_at": [newest], "suppressed_until": [until]})


def fetch_states(outcomes: DataFrame) -> DataFrame:
    """Fetch state per (company, provider) after each batch of outcomes (company_id, provider, seq, at, ok, and newest where there is one).

    A batch is folded in the order of seq, batches in the order of their arrival; a failure that
    comes after a later success counts from there on.
    """
    if "newest" not in outcomes.columns:
        outcomes = outcomes.withColumn("newest", F.lit(None).cast("timestamp"))
    return outcomes.groupBy("company_id", "provider").applyInPandasWithState(_fold_fetches, FETCH_OUT, FETCH_STATE, "update", GroupStateTimeout.NoTimeout)


REVISION_STATE = "digest string, updated timestamp, deleted boolean, revision int"


def _fold_events(strict: bool):
    def fold(key, frames, kept: GroupState):
        last = state.Last(*kept.get) if kept.exists else state.Last()
        rows = pd.concat(list(frames)).sort_values(["seq", "content_hash"])
        taken = [last.takes(r.content_hash, r.updated_at, r.deleted, strict) for r in rows.itertuples(index=False)]
        kept.update((last.digest, last.updated, last.deleted, last.revision))
        out = rows[taken]
        yield out.assign(revision=range(last.revision - len(out) + 1, last.revision + 1))

    return fold


def revisions(events: DataFrame, strict_tombstones: bool = False) -> DataFrame:
    """Revisions of source articles as their events arrive (columns of state.REVISION).

    The state of an article is a hash, a time and a number, whatever it went through; events of
    a batch are taken in the order of seq, batches in the order of their arrival, as an ingest
    run would.
    """
    rows = state.events_of(events)
    return rows.groupBy(*state.KEY).applyInPandasWithState(_fold_events(strict_tombstones), state.REVISION, REVISION_STATE, "append", GroupStateTimeout.NoTimeout)


def run_revisions(stream: DataFrame, path: str, checkpoint: str, strict_tombstones: bool = False):
    """Append the revisions of all available events to the files below path; replays of a batch add nothing."""
    query = revisions(stream, strict_tombstones).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """The history that run_revisions wrote, as readers may see it."""
    return state.scrubbed(spark.read.schema(state.REVISION).parquet(path))


def run_states(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run all available batches of a stream of updates into files, a folder for each batch, and give each key's last update.

    A batch that is run again overwrites its folder; rows stay on the executors.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    updates = spark.read.schema(stream.schema).option("basePath", path).parquet(f"{path}/epoch=*")
    latest = F.max_by(F.struct(*stream.columns), "epoch").alias("row")
    return updates.withColumn("epoch", F.regexp_extract(F.col("_metadata.file_path"), "epoch=([0-9]+)", 1).cast("long")).groupBy(*keys).agg(latest).select("row.*")


def run_upserts(stream: DataFrame, state_path: str, checkpoint: str, merge):
    """Run all available batches of stream through merge into a versioned state."""
    query = stream.writeStream.foreachBatch(upsert_batches(state_path, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
