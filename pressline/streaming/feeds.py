"""Which entries of a polled feed to fetch, as a stateful stream.

A feed tells of its current entries at each poll; a fetcher tells what became of an entry's
body.  Both come as rows of EVENTS, and ``pending`` answers with the entries to fetch and why:

* ``new``: not known; an entry that left the feed is forgotten, so it is new when it comes back;
* ``changed``: its fingerprint differs from the one that was fetched;
* ``retry``: its body failed, one to RETRIES times in a row;
* ``image``: its body was imported before images were looked for;
* ``due``: the feed's last full scan is FULL_SCAN_HOURS old.

A body that was denied is never asked for again.  The batch form of one poll is
:func:`pressline.operators.state.fingerprint_diff`.

State is kept by feed: a map of its current entries (bounded by the feed), and its last scan.  A
poll may be spread over batches: what a poll leaves out is forgotten when the next one begins.
Timers do what no poll does: a feed that is silent while others go on is due by itself after
FULL_SCAN_HOURS, and is dropped after ``keep``.  In processing time the map has a time to live,
too, which a feed that never comes again runs out of.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: kind is poll or fetched; a poll of an empty feed is a row without entry_id; number counts the events of a feed.
EVENTS = "feed string, kind string, number bigint, at timestamp, entry_id string, fingerprint string, outcome string, image_checked boolean"
PENDING = "feed string, number bigint, at timestamp, entry_id string, fingerprint string, why string"
FULL_SCAN_HOURS, RETRIES, MOST_FAILURES = 24, 3, 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ENTRY = "fingerprint string, imported boolean, failures int, blocked boolean, image_checked boolean, fetched boolean, poll bigint"
_SCAN = "scanned bigint, poll bigint, due boolean, at bigint, timer bigint"


def reason(known, fingerprint: str | None, due: bool, retries: int = RETRIES) -> str | None:
    """Why an entry is fetched; known is its state (the fields of _ENTRY), None for one that was never fetched."""
    if known is None:
        return "new"
    seen, imported, failures, blocked, image_checked = known[:5]
    if blocked:
        return None
    if seen != fingerprint:
        return "changed"
    if 0 < failures <= retries:
        return "retry"
    if imported and not image_checked and not failures:
        return "image"
    return "due" if due else None


def fetched(known, fingerprint, outcome: str, image_checked: bool | None):
    """The state of an entry after its body was asked for: ok, failed or blocked."""
    _, imported, failures, _, had_image = known[:5] if known is not None else (None, False, 0, False, False)
    ok = outcome == "ok"
    checked = ok if image_checked is None else bool(image_checked)
    return fingerprint, ok or imported, 0 if ok else min(failures + 1, MOST_FAILURES), outcome == "blocked", checked or had_image


class _Feed(StatefulProcessor):
    def __init__(self, keep: timedelta, processing_time: bool):
        self.keep, self.processing_time = keep, processing_time

    def init(self, handle):
        self.handle = handle
        ttl = int(self.keep.total_seconds() * 1000) if self.processing_time else None
        self.entries = handle.getMapState("entries", "entry_id string", _ENTRY, ttl)
        self.scan = handle.getValueState("scan", _SCAN)

    def _timer(self, old, scanned: int, last: int) -> int:
        """The next time at which the feed does something by itself: its full scan, or being dropped."""
        if old is not None:
            self.handle.deleteTimer(old)
        due = scanned + FULL_SCAN_HOURS * 3_600_000
        end = last + int(self.keep.total_seconds() * 1000)
        self.handle.registerTimer(min(due, end))
        return min(due, end)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (the interface's names)
        table = pd.concat(list(rows)).sort_values(["number", "entry_id"], na_position="first")
        scanned, poll, due, last, timer = self.scan.get() if self.scan.exists() else (None, None, False, 0, None)
        clock, out = timerValues.getCurrentProcessingTimeInMs() if self.processing_time else None, []
        for r in table.itertuples(index=False):
            at = clock or int(r.at.timestamp() * 1000)
            entry = r.entry_id if isinstance(r.entry_id, str) else None
            known = self.entries.getValue((entry,)) if entry is not None and self.entries.containsKey((entry,)) else None
            if r.kind == "poll":
                if poll != r.number:  # a poll begins: what the one before left out is forgotten
                    for (name,), held in list(self.entries.iterator()):
                        if poll is not None and held[6] != poll:
                            self.entries.removeKey((name,))
                            known = None if name == entry else known
                    due = scanned is None or at - scanned >= FULL_SCAN_HOURS * 3_600_000
                    scanned, poll, last = at if due else scanned, r.number, at
                if entry is None:
                    continue
                why = reason(known if known is not None and known[5] else None, r.fingerprint, due)
                if why:
                    out.append((key[0], r.number, r.at, entry, r.fingerprint, why))
                now = known[:6] if known is not None else (None, False, 0, False, False, False)
                self.entries.updateValue((entry,), (*now, r.number))
            elif entry is not None:
                held = poll if known is None else known[6]
                self.entries.updateValue((entry,), (*fetched(known if known is not None and known[5] else None, r.fingerprint, r.outcome, r.image_checked if isinstance(r.image_checked, bool) else None), True, held if held is not None else -1))
        if scanned is not None:
            timer = self._timer(timer, scanned, last)
            self.scan.update((scanned, poll, due, last, timer))
        yield pd.DataFrame(out, columns=["feed", "number", "at", "entry_id", "fingerprint", "why"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        scanned, poll, _, last, timer = self.scan.get()
        out = []
        if timer == at:
            if at >= last + int(self.keep.total_seconds() * 1000):
                self.entries.clear()
                self.scan.clear()
            else:
                when = datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None)
                for (name,), held in self.entries.iterator():
                    why = reason(held if held[5] else None, held[0], True)
                    if why:
                        out.append((key[0], poll, when, name, held[0], why))
                self.scan.update((at, poll, False, last, self._timer(None, at, last)))
        yield pd.DataFrame(out, columns=["feed", "number", "at", "entry_id", "fingerprint", "why"])

    def close(self):
        pass


def pending(events: DataFrame, *, keep: timedelta = timedelta(days=30), delay: str = "1 hour", processing_time: bool = False) -> DataFrame:
    """Rows of PENDING as the events of feeds arrive, in the order of their numbers within a batch.

    The session needs the RocksDB state store (PROVIDER).  By default time is that of the
    events, so a replay gives the same; with processing_time scans, timers and the time to live
    go by the clock, for a query that runs on (it never has seen all there is).
    """
    rows = events if processing_time else events.withWatermark("at", delay)
    return rows.groupBy("feed").transformWithStateInPandas(_Feed(keep, processing_time), PENDING, "Append", "ProcessingTime" if processing_time else "EventTime")


def run_pending(stream: DataFrame, path: str, checkpoint: str, **options):
    """Append what is pending to the files below path, for all available events."""
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)  # read when the query starts
    try:
        query = pending(stream, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return query


def read_pending(spark, path: str) -> DataFrame:
    return spark.read.schema(PENDING).parquet(path)


def events(polls: DataFrame, results: DataFrame) -> DataFrame:
    """Polls (feed, number, at, entry_id, fingerprint) and results (.., outcome, image_checked) as EVENTS."""
    one = polls.withColumns({"kind": F.lit("poll"), "outcome": F.lit(None).cast("string"), "image_checked": F.lit(None).cast("boolean")})
    two = results.withColumn("kind", F.lit("fetched"))
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return one.select(*names).unionByName(two.select(*names))
