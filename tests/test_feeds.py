"""Pending entries of polled feeds: the stateful stream against a plain loop over the documented rules, its timers, and replays."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest

from pressline.operators import state
from pressline.streaming import feeds

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def plain(events):
    """feed -> what is pending, by the rules as they are written down, over dicts of the whole history."""
    seen, scans, out = {}, {}, []
    polls = {}
    for feed, kind, number, at, entry, print_, outcome, image in sorted(events, key=lambda e: (e[0], e[2], e[4] or "")):
        if kind == "poll":
            polls.setdefault((feed, number, at), {})[entry] = print_
        else:
            polls.setdefault((feed, number, at), []).append((entry, print_, outcome, image))
    for (feed, number, at), what in sorted(polls.items(), key=lambda p: (p[0][0], p[0][1])):
        mine = seen.setdefault(feed, {})
        if isinstance(what, dict):
            current = {e: p for e, p in what.items() if e is not None}
            for e in [e for e in mine if e not in current]:
                del mine[e]
            due = feed not in scans or at - scans[feed] >= 24 * HOUR
            if due:
                scans[feed] = at
            for e, p in current.items():
                s = mine.get(e)
                if s is None:
                    out.append((feed, number, e, "new"))
                elif s["blocked"]:
                    continue
                elif s["print"] != p:
                    out.append((feed, number, e, "changed"))
                elif 1 <= s["failures"] <= 3:
                    out.append((feed, number, e, "retry"))
                elif s["imported"] and not s["image"] and s["failures"] == 0:
                    out.append((feed, number, e, "image"))
                elif due:
                    out.append((feed, number, e, "due"))
        else:
            for e, p, outcome, image in what:
                s = mine.get(e, {"imported": False, "failures": 0, "image": False})
                ok = outcome == "ok"
                mine[e] = {"print": p, "imported": ok or s["imported"], "failures": 0 if ok else s["failures"] + 1, "blocked": outcome == "blocked", "image": (ok if image is None else image) or s["image"]}
    return sorted(out)


def story(seed, feeds_=2, polls=9):
    """Random polls, and results for what the plain loop finds pending."""
    rng, events = random.Random(seed), []
    for feed in (f"f{i}" for i in range(feeds_)):
        at, prints = START + rng.random() * HOUR, {}
        for n in range(polls):
            at += rng.choice([1, 2, 9, 26]) * HOUR
            current = [e for e in "abcdefgh" if rng.random() < 0.85] if rng.random() < 0.9 else []
            for e in current:
                if e not in prints or rng.random() < 0.15:
                    prints[e] = f"{e}{rng.randrange(99)}"
            events += [(feed, "poll", 2 * n, at, e, prints[e], None, None) for e in current] or [(feed, "poll", 2 * n, at, None, None, None, None)]
            for f, number, e, _ in plain(events):
                if f == feed and number == 2 * n and rng.random() < 0.9:
                    events.append((feed, "fetched", 2 * n + 1, at + HOUR / 60, e, prints[e], rng.choices(["ok", "failed", "blocked"], [6, 5, 1])[0], rng.choice([None, True, False, None])))
    return events


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """A worker starts for every task of a stateful batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, batches, **options):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, feeds.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={i:03}")
    stream = spark.readStream.schema(feeds.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    feeds.run_pending(stream, f"{tmp_path}/out", f"{tmp_path}/check", **options)
    return sorted((r["feed"], r["number"], r["entry_id"], r["why"]) for r in feeds.read_pending(spark, f"{tmp_path}/out").collect())


def test_stream_equals_the_plain_loop(spark, tmp_path):
    events = story(1)
    assert {w for *_, w in plain(events)} == {"new", "changed", "retry", "image", "due"}
    by_time = sorted(events, key=lambda e: (e[2], e[0]))
    size = 61  # batches cut polls in two
    got = run(spark, tmp_path, [by_time[i : i + size] for i in range(0, len(by_time), size)], delay="400 hours")  # no timer comes first
    assert got == plain(events)


def test_batch_form_is_one_poll_of_the_loop(spark):
    events = story(3, feeds_=2)
    last = max(e[2] for e in events if e[1] == "poll")
    before = [e for e in events if e[2] < last]
    want = [w for w in plain(events) if w[1] == last]
    # the state that the loop has before the last poll, rebuilt from the events by the same rules
    seen, scans = [], []
    for feed in ("f0", "f1"):
        mine, scanned = {}, None
        for number in sorted({e[2] for e in before if e[0] == feed}):
            rows = [e for e in before if e[0] == feed and e[2] == number]
            if rows[0][1] == "poll":
                mine = {k: v for k, v in mine.items() if k in {r[4] for r in rows}}
                scanned = rows[0][3] if scanned is None or rows[0][3] - scanned >= 24 * HOUR else scanned
            else:
                for r in rows:
                    known = mine.get(r[4])
                    mine[r[4]] = feeds.fetched(known, r[5], r[6], r[7])
        seen += [(feed, e, *s) for e, s in mine.items()]
        scans.append((feed, scanned))
    polls = [e for e in events if e[2] == last and e[1] == "poll" and e[4]]
    out = []
    for feed in ("f0", "f1"):
        mine = [p for p in polls if p[0] == feed]
        if not mine:
            continue
        entries = spark.createDataFrame([(p[0], p[4], p[5]) for p in mine], "feed string, entry_id string, fingerprint string")
        known = spark.createDataFrame(seen, "feed string, entry_id string, seen_fingerprint string, imported boolean, failures int, blocked boolean, image_checked boolean")
        when = spark.createDataFrame(scans, "feed string, scanned_at timestamp")
        out += [(r["feed"], last, r["entry_id"], r["why"]) for r in state.fingerprint_diff(entries, known, when, mine[0][3]).filter("why IS NOT NULL").collect()]
    assert sorted(out) == want


def test_a_silent_feed_is_due_by_its_timer_and_dropped_later(spark, tmp_path):
    poll = lambda feed, n, hours, entry: (feed, "poll", n, START + hours * HOUR, entry, "p", None, None)
    ok = lambda feed, n, hours, entry: (feed, "fetched", n, START + hours * HOUR, entry, "p", "ok", None)
    denied = lambda feed, n, hours, entry: (feed, "fetched", n, START + hours * HOUR, entry, "p", "blocked", None)
    batches = [[poll("quiet", 0, 0, "a"), poll("quiet", 0, 0, "b"), ok("quiet", 1, 0.1, "a"), denied("quiet", 1, 0.1, "b")]]
    batches += [[poll("busy", n, h, "x"), ok("busy", n + 1, h, "x")] for n, h in zip(range(0, 20, 2), (1, 20, 27, 40, 52, 60, 80, 90), strict=False)]
    batches.append([poll("quiet", 2, 90, "a")])
    got = [r for r in run(spark, tmp_path, batches, keep=timedelta(hours=60)) if r[0] == "quiet"]
    # twice due by itself (after 24 and 48 hours), then dropped, so its entry is new again; the denied body never
    assert got == [("quiet", 0, "a", "due"), ("quiet", 0, "a", "due"), ("quiet", 0, "a", "new"), ("quiet", 0, "b", "new"), ("quiet", 2, "a", "new")]


def test_pending_reads_on_after_a_stop(spark, tmp_path):
    events = sorted(story(5, feeds_=2, polls=4), key=lambda e: (e[2], e[0]))
    half = len(events) // 2
    run(spark, tmp_path, [events[:half]], delay="400 hours")
    for i in range(2):  # nothing new the second time
        spark_in = [events[half:]] if i == 0 else []
        for batch in spark_in:
            spark.createDataFrame(batch, feeds.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/late")
        stream = spark.readStream.schema(feeds.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        feeds.run_pending(stream, f"{tmp_path}/out", f"{tmp_path}/check", delay="400 hours")
    got = sorted((r["feed"], r["number"], r["entry_id"], r["why"]) for r in feeds.read_pending(spark, f"{tmp_path}/out").collect())
    assert got == plain(events)


def test_processing_time_goes_by_the_clock(spark, tmp_path):
    events = [("f", "poll", 2 * n, START + 30 * n * HOUR, e, "p", None, None) for n in range(2) for e in "ab"] + [("f", "fetched", 1, START, "a", "p", "ok", None)]
    spark.createDataFrame(sorted(events, key=lambda e: e[2]), feeds.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(feeds.EVENTS).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.PROVIDER)
    try:
        query = feeds.pending(stream, processing_time=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        for _ in range(120):  # such a query goes on for as long as the clock does
            time.sleep(0.5)
            if os.path.isdir(f"{tmp_path}/out/_spark_metadata") and feeds.read_pending(spark, f"{tmp_path}/out").count():
                break
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["number"], r["entry_id"], r["why"]) for r in feeds.read_pending(spark, f"{tmp_path}/out").collect())
    assert got == [(0, "a", "new"), (0, "b", "new"), (2, "b", "new")]  # not due: no day has passed by the clock
