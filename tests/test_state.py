"""State transitions: idempotence, paging, folds against plain versions, batch against stream."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressline.operators import analytics, reads, resolution, state, v2
from pressline.plans import catalogue
from pressline.sources import files
from pressline.sources.sinks import latest_state, write_csv
from pressline.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


BATCH = "company_id long, dedupe_hash string, content_hash string, relevance double, seq long"


def test_ingest_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "u1", "c1", 0.9, 1), (1, "u1", "c1", 0.9, 2), (1, "u2", "c1", 0.9, 3), (2, "u1", "c1", 0.9, 4), (2, "u3", "c3", 0.1, 5)], BATCH)
    none_a = spark.createDataFrame([], "dedupe_hash string, content_hash string")
    none_l = spark.createDataFrame([], "dedupe_hash string, company_id long")
    parts = state.store_articles(batch, none_a, none_l)
    assert rows(state.store_stats(state.store_verdicts(batch, none_a, none_l))) == [(5, 1, 2, 1)]
    stored = parts["inserted"].select("dedupe_hash", "content_hash")
    links = parts["linked"].select("dedupe_hash", "company_id")
    again = state.store_articles(batch, stored, links)
    assert again["inserted"].isEmpty() and again["linked"].isEmpty()


def plain_store(batch, articles, links, floor):
    """The batch one row after the other, as an ingest run stores it."""
    stored, linked, out = dict(articles), set(links), []
    have = {(c, stored[d]) for d, c in links if d in stored}
    seen = set()
    for company, url, story, score, seq in sorted(batch, key=lambda r: r[4]):
        if (company, url) in seen:
            out.append((seq, "repeat", False, False))
            continue
        seen.add((company, url))
        if (company, story) in have:
            out.append((seq, "known", False, False))
        elif score < floor:
            out.append((seq, "rejected", False, False))
        else:
            out.append((seq, "kept", url not in stored, (url, company) not in linked))
            stored.setdefault(url, story)
            linked.add((url, company))
            have.add((company, story))
    return sorted(out)


def test_a_rejected_story_does_not_block_its_better_sourced_twin(spark):
    batch = spark.createDataFrame([(1, "u1", "c1", 0.1, 1), (1, "u2", "c1", 0.9, 2), (1, "u3", "c1", 0.1, 3), (1, "u1", "c1", 0.9, 4)], BATCH)
    none_a, none_l = spark.createDataFrame([], "dedupe_hash string, content_hash string"), spark.createDataFrame([], "dedupe_hash string, company_id long")
    got = state.store_verdicts(batch, none_a, none_l).select("seq", "verdict").collect()
    assert sorted(map(tuple, got)) == [(1, "rejected"), (2, "kept"), (3, "known"), (4, "repeat")]


def test_store_verdicts_follow_a_plain_run(spark):
    rng = random.Random(8)
    for n in range(4):
        batch = [(rng.randrange(4), f"u{(s := rng.randrange(40))}", f"c{s % 13}", rng.choice([0.1, 0.3, 0.5, 0.9]), i) for i in range(250)]
        articles = [(f"u{s}", f"c{s % 13}") for s in rng.sample(range(40), 5)]
        links = [(u, rng.randrange(4)) for u, _ in articles]
        got = state.store_verdicts(spark.createDataFrame(batch, BATCH), spark.createDataFrame(articles, "dedupe_hash string, content_hash string"), spark.createDataFrame(links, "dedupe_hash string, company_id long"))
        assert sorted(map(tuple, got.select("seq", "verdict", "inserted", "linked").collect())) == plain_store(batch, articles, links, 0.35), n


def test_resolved_links_merge_into_the_owner_of_the_story(spark):
    s = "https://a.com/s/"
    articles = [(1, "https://finnhub.io/x1"), (2, "https://finnhub.io/x2"), (3, "https://finnhub.io/x3"), (4, "https://finnhub.io/x4"), (5, "https://finnhub.io/x5"), (6, "https://a.com/same"), (7, "https://www.a.com/same"), (9, s + "1"), (10, "https://finnhub.io/x10")]
    resolved = [(1, "http://www.a.com/s/1/"), (2, s + "2"), (3, s + "2?utm_source=x"), (4, "https://chartmill.com/z"), (5, None), (10, s + "1")]
    links = [(1, 100), (1, 101), (2, 100), (3, 100), (3, 102), (4, 100), (5, 100), (6, 1), (7, 1), (9, 101), (10, 103)]
    out = state.merge_colliding(spark.createDataFrame(articles, "id long, url string"), spark.createDataFrame(links, "article_id long, company_id long"), spark.createDataFrame(resolved, "id long, new_url string"))
    assert rows(out["deleted"]) == rows(spark.createDataFrame([(1, "merged"), (3, "merged"), (4, "dead"), (10, "merged")], "id long, action string"))
    # the owner of s/1 has the larger id; two untouched articles of one story stay; an unresolved wrapper stays
    assert {r["id"]: r["url"] for r in out["articles"].collect()} == {2: s + "2", 5: articles[4][1], 6: articles[5][1], 7: articles[6][1], 9: s + "1"}
    assert sorted(map(tuple, out["links"].collect())) == [(2, 100), (2, 102), (5, 100), (6, 1), (7, 1), (9, 100), (9, 101), (9, 103)]


def test_pages_put_together_are_the_whole(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"{i:03}", datetime(2024, 1, 1) + timedelta(days=rng.randrange(5))) for i in range(47)], "id string, published_at timestamp")
    whole = [tuple(r) for r in df.orderBy(F.desc("published_at"), F.desc("id")).collect()]
    got, cursor = [], None
    while True:
        page = [tuple(r) for r in v2.keyset_page(df, 10, cursor).collect()]
        got += page[:10]
        if len(page) <= 10:
            break
        cursor = (str(page[9][1]), page[9][0])
    assert got == whole


def fold_fetches(events):
    fails, ok_at, until = 0, None, None
    for _, at, ok in sorted(events):
        if ok:
            fails, ok_at, until = 0, at, None
        else:
            fails += 1
            until = at + timedelta(hours=24) if fails >= 5 else None
    return fails, ok_at, until


def test_fetch_state_by_windows_and_by_stream(spark, tmp_path):
    rng = random.Random(5)
    data = [(rng.randrange(4), "p", i, datetime(2024, 1, 1) + timedelta(hours=i), rng.random() < 0.15) for i in range(80)]
    df = spark.createDataFrame(data, "company_id long, provider string, seq long, at timestamp, ok boolean").withColumn("newest", F.lit(None).cast("timestamp"))
    got = {r["company_id"]: (r["consecutive_failures"], r["last_success_at"], r["suppressed_until"]) for r in state.fetch_state(df).collect()}
    want = {c: fold_fetches([(s, at, ok) for k, _, s, at, ok in data if k == c]) for c in {d[0] for d in data}}
    assert got == want
    df.drop("newest").repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    stream = jobs.fetch_states(jobs.read_files(spark, str(tmp_path / "in"), "company_id long, provider string, seq long, at timestamp, ok boolean", 100))
    q = stream.writeStream.format("memory").queryName("fetches").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["company_id"]: r["consecutive_failures"] for r in spark.table("fetches").collect()} == {c: w[0] for c, w in want.items()}


EVENTS = "provider_id string, source_id string, action string, headline string, body string, updated_at timestamp, seq long"


def test_revisions(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    data = [("p", "a", "upsert", "h1", "b1", t(1), 1), ("p", "a", "upsert", "h1", "b1", t(1), 2), ("p", "a", "upsert", "h2", "b2", t(3), 3), ("p", "a", "upsert", "old", "x", t(2), 4), ("p", "a", "delete", "h2", "b2", t(4), 5), ("p", "a", "upsert", "back", "b3", None, 6), ("p", "b", "upsert", "only", None, None, 1)]
    df = spark.createDataFrame(data, EVENTS)
    got = [(r["source_id"], r["revision"], r["headline"], r["body"], r["deleted"]) for r in state.revisions(df).orderBy("source_id", "revision").collect()]
    assert got == [("a", 1, "h1", None, False), ("a", 2, "h2", None, False), ("a", 3, state.WITHDRAWN, None, True), ("a", 4, "back", "b3", False), ("b", 1, "only", None, False)]
    strict = state.current(state.revisions(df, strict_tombstones=True))
    assert {r["source_id"]: r["deleted"] for r in strict.collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("name, turn", [("revision_history", 0), ("stream_upsert_state", 1)])
def test_revision_queries_keep_whole_bodies(spark, tmp_path, name, turn):
    """Versions of one time and headline that differ late in the body are versions (the stream's state has one event a turn)."""
    long = "word " * 300
    data = [(1, 0, "user", long + "a"), (1, turn, "user", long + "b"), (1, turn, "user", long + "b"), (2, 1, "user", long)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r["source_id"], r["revision"], r["body"]) for r in catalogue.queries()[name](spark, str(tmp_path)).orderBy("source_id", "revision").collect()]
    assert [(i, n) for i, n, _ in got] == [("1", 1), ("1", 2), ("2", 1)]
    assert sorted(b for _, _, b in got) == sorted([long + "a", long + "b", long])


def test_scrub_and_topics_read_whole_texts(spark, tmp_path):
    long = "word " * 300
    spark.createDataFrame([(1, 0, "user", long + "a"), (1, 0, "user", long + "b")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in catalogue.queries()["tombstone_scrub"](spark, str(tmp_path)).select("articles", "bodies", "revisions").collect()] == [(1, 1, 2)]
    spark.createDataFrame([(2, long + "inflation"), (3, long)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["topics"] for r in catalogue.queries()["topic_tags"](spark, str(tmp_path)).collect()}
    assert "inflation" in got[2] and "inflation" not in got[3]


def plain_revisions(events, strict=False):
    """(source, revision, headline, body, summary, url, deleted) of each kept event, as one ingest run after the other stores them."""
    out = {}
    for provider, source, action, head, summary, body, url, at, _ in sorted(events, key=lambda e: e[-1]):
        history = out.setdefault(source, [])
        gone = action == "delete"
        row = {"head": state.WITHDRAWN if gone else head, "summary": None if gone else summary, "body": None if gone else body, "url": url, "at": at, "gone": gone}
        same = lambda a, b: all(a[k] == b[k] for k in ("head", "summary", "body", "at", "gone")) and (a["gone"] or a["url"] == b["url"])
        if history:
            last = history[-1]
            if same(last["raw"], row) or (last["at"] and at and at < last["at"]):
                continue
            if strict and last["gone"] and not gone and not (at and last["at"] and at > last["at"]):
                continue
        kept = dict(row, raw=row)
        if gone:
            kept["url"] = next((h["url"] for h in reversed(history) if not h["gone"]), url)
            for h in history:
                h["body"] = h["summary"] = None
        history.append(kept)
    return sorted((s, n + 1, h["head"], h["body"], h["summary"], h["url"], h["gone"]) for s, hs in out.items() for n, h in enumerate(hs))


FULL = "provider_id string, source_id string, action string, headline string, summary string, body string, url string, updated_at timestamp, seq long"
SEEN = ("source_id", "revision", "headline", "body", "summary", "url", "deleted")


def many_events(seed, n=160):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.2 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(30))
    return [("p", f"s{rng.randrange(7)}", rng.choice(["upsert"] * 4 + ["delete"]), f"h{rng.randrange(3)}", rng.choice([None, "s1", "s2"]), f"b{rng.randrange(3)}", f"u{rng.randrange(2)}", when(), i) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
def test_revisions_follow_a_plain_run(spark, strict):
    for seed in (1, 2):
        data = many_events(seed)
        got = state.revisions(spark.createDataFrame(data, FULL), strict).select(*SEEN).collect()
        assert sorted(map(tuple, got)) == plain_revisions(data, strict)


def test_stream_of_revisions_equals_the_batch_and_replays_change_nothing(spark, tmp_path):
    data = many_events(9)
    df = spark.createDataFrame(data, FULL)
    for part in range(3):  # files in the order of seq, one a batch
        df.filter(f"seq >= {part * 54} AND seq < {part * 54 + 54}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.run_revisions(jobs.read_files(spark, str(tmp_path / "in"), FULL, 1), str(tmp_path / "history"), str(tmp_path / "check"))
    assert rows(jobs.read_revisions(spark, str(tmp_path / "history")).select(*SEEN)) == rows(state.revisions(df).select(*SEEN))


def test_purged_bodies_and_links_of_the_current_revision(spark):
    data = [("p", "a", "upsert", "h", "b", '["Acme", "Beta"]', 1), ("p", "b", "upsert", "h", "b", '["Acme"]', 1), ("p", "b", "delete", "h", None, '["Acme"]', 2), ("q", "c", "upsert", "h", None, None, 1), ("p", "a", "upsert", "h2", "b2", '["Beta"]', 2)]
    history = state.revisions(spark.createDataFrame(data, "provider_id string, source_id string, action string, headline string, body string, companies string, seq long"))
    matches = spark.createDataFrame([("Acme", 1), ("Beta", 2)], "hint string, company_id long")
    assert rows(state.revision_links(history, matches)) == [("p", "a", 2)]
    purged = {(r["source_id"], r["revision"]): (r["body"], r["content_hash"][:7] == "purged:") for r in state.purge_bodies(history, ["p"]).collect()}
    assert purged == {("a", 1): (None, True), ("a", 2): (None, True), ("b", 1): (None, False), ("b", 2): (None, False), ("c", 1): (None, False)}


def test_unfinished_versions_are_not_read(spark, tmp_path):
    from pressline.sources.sinks import upsert_batches

    add = lambda old, batch: batch if old is None else old.unionByName(batch)
    apply = upsert_batches(str(tmp_path / "s"), add)
    assert latest_state(spark, str(tmp_path / "s")) is None
    for epoch in range(4):
        apply(spark.createDataFrame([(epoch,)], "n int"), epoch)
    apply(spark.createDataFrame([(3,)], "n int"), 3)  # a replay
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["v2", "v3"]
    spark.createDataFrame([(9,)], "n int").write.parquet(str(tmp_path / "s" / "v4"))
    (tmp_path / "s" / "v4" / "_SUCCESS").unlink()
    assert rows(latest_state(spark, str(tmp_path / "s"))) == [(0,), (1,), (2,), (3,)]


def test_catalogue_merge(spark):
    old = spark.createDataFrame([("A", "Acme", "LSE", "resolved", True), ("B", "Beta", None, "resolved", True), ("C", "Gone", None, "resolved", True), ("D", "Back", None, "resolved", False)], "ticker string, company_name string, exchange_hint string, resolution_status string, is_active boolean")
    new = spark.createDataFrame([("A", "Acme", "LSE"), ("B", "Beta plc", None), ("D", "Back", None), ("E", "New", None)], "ticker string, company_name string, exchange_hint string")
    got = {r["ticker"]: (r["resolution_status"], r["is_active"], r["change"]) for r in state.catalogue_merge(old, new).collect()}
    assert got == {"A": ("resolved", True, "unchanged"), "B": ("pending", True, "updated"), "C": ("resolved", False, "deactivated"), "D": ("resolved", True, "updated"), "E": ("pending", True, "inserted")}
    merged = state.catalogue_merge(old, new)
    assert {r["change"] for r in state.catalogue_merge(merged, new).filter("ticker <> 'C'").collect()} == {"unchanged"}


def test_windows_and_suppression(spark):
    now = datetime(2024, 6, 1)
    df = spark.createDataFrame([(None,), (datetime(2024, 5, 31, 12),), (datetime(2024, 1, 1),)], "last timestamp")
    at = F.lit(now)
    got = [tuple(r) for r in df.select(state.fetch_from(F.col("last"), at), state.fetch_from(F.col("last"), at, 3)).collect()]
    assert [g[0] for g in got] == [now - timedelta(days=90), datetime(2024, 5, 31, 6), now - timedelta(days=30)]
    assert {g[1] for g in got} == {now - timedelta(days=3)}
    st = spark.createDataFrame([(1, "p", now + timedelta(hours=1)), (2, "p", now)], "company_id long, provider string, suppressed_until timestamp")
    todo = spark.createDataFrame([(1, "p"), (2, "p")], "company_id long, provider string")
    assert rows(state.not_suppressed(todo, st, now)) == [(2, "p")]
    assert len(rows(state.not_suppressed(todo, st, now, override=True))) == 2


@pytest.mark.parametrize(
    "attempts,want",
    [
        ([("a", "error"), ("b", "ok")], "ok"),
        ([("a", "error"), ("b", "no_news")], "error"),
        ([("a", "no_news"), ("b", "error")], "no_news"),
        ([("c", "no_news"), ("b", "error")], "error"),
        ([("a", "skipped")], "skipped"),
        ([("c", "no_news")], "no_news"),
        ([], "skipped"),
    ],
)
def test_cascade_outcomes(spark, attempts, want):
    df = spark.createDataFrame([(attempts,)], "x array<struct<provider:string,outcome:string>>")
    assert rows(df.select(state.cascade_outcome(F.col("x"), F.array(F.lit("a"))))) == [(want,)]


def test_watermark_holds_on_incomplete_windows(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 5, False), (7, 5, True)], "old int, new int, complete boolean")
    assert [r[0] for r in df.select(state.advance_watermark(F.col("old"), F.col("new"), F.col("complete"))).collect()] == [5, 1, 7]


def test_csv_source(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes('﻿ticker,company_name,sector,country,is_us_listed,exchange_hint\r\nA,"Acme, ""The"" Co",,us,Yes,NYSE\r\n,,,,,\r\nA,Again,,us,no,\r\nB,"two\nlines",x\r\n'.encode())
    raw = files.read_csv(spark, str(path), "ticker string, company_name string, sector string, country string, is_us_listed string, exchange_hint string")
    assert raw.count() == 3
    kept = files.catalogue(raw.withColumn("line", F.monotonically_increasing_id()), "line").drop("line", "name_normalized")
    assert rows(kept) == [("A", 'Acme, "The" Co', None, "US", True, "NYSE"), ("B", "two\nlines", "x", None, None, None)]
    out = str(tmp_path / "out")
    write_csv(kept.select("ticker", "company_name"), out)
    assert rows(files.read_csv(spark, out, "ticker string, company_name string")) == [("A", 'Acme, "The" Co'), ("B", "two\nlines")]


def test_snapshot_is_rejected_as_a_whole(spark):
    cols = "ticker string, company_name string, country string, exchange_hint string, resolution_status string, exchange_code string, symbol string, symbol_format string, security_kind string, confidence double, source string, is_us boolean, is_primary boolean"
    good = ("A", "Acme", "GB", None, "resolved", "LN", "ACM", "suffixed", "ordinary", 0.9, "directory", False, True)
    assert files.listing_snapshot(spark.createDataFrame([good], cols)).count() == 1
    for bad in ([], [good, (*good[:6], None, *good[7:])], [(*good[:9], 1.5, *good[10:])], [good, ("A", "Other", *good[2:])]):
        with pytest.raises(files.InvalidSource):
            files.listing_snapshot(spark.createDataFrame(bad, cols))


def test_rss_one_or_many_items(spark):
    one = "<rss><channel><item><title>T &amp; U</title><link>https://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"
    many = one.replace("</channel>", "<item><title>V</title><link>https://a/2</link></item></channel>")
    df = spark.createDataFrame([("x", one), ("y", many), ("z", "<rss><channel/></rss>")], "feed string, xml string")
    got = rows(files.rss_items(df, "xml", "feed").select("feed", "title", "url", "published_at"))
    assert got == [("x", "T & U", "https://a/1", datetime(2024, 1, 2, 3, 4, 5)), ("y", "T & U", "https://a/1", datetime(2024, 1, 2, 3, 4, 5)), ("y", "V", "https://a/2", None)]


def test_json_paths(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,2,{"c":null}]},"d":[],"e":"x"}'), (1, '{"a":{"b":[true]},"d":{}}')], "k int, j string")
    got = {r["path"]: (r["types"], r["n"], r["samples"]) for r in analytics.json_paths(df, "j", "k").collect()}
    assert got["a.b[]"] == ("boolean, number", 3, "1\n2\ntrue")
    assert got["a.b[].c"] == ("null", 1, "null")
    assert got["d"][0] == "array (empty), object (empty)"
    assert got["e"] == ("string", 1, '"x"')


def test_similarity_join_finds_all_pairs(spark):
    words = ["Acme Steel Works", "ACME STEEL WORKS INC", "Acme Steelworks", "Concentra Holdings Partners", "CONCENTRA PAR", "Wabtec", "Westinghouse Air Brake Technologies", "Novo Nordisk", "Nova", "Auto Trader", "Autotrader plc"]
    df = spark.createDataFrame(list(enumerate(words)), "i long, n string")
    from pressline.functions import names

    a, b = df.toDF("lid", "lname"), df.toDF("rid", "rname")
    every = a.crossJoin(b).withColumn("s", names.name_similarity(F.col("lname"), F.col("rname"))).filter("s >= 0.6").select("lid", "rid")
    assert rows(resolution.similar(a, b).select("lid", "rid")) == rows(every)


def test_alias_interval(spark):
    df = spark.createDataFrame([(1, True, date(2024, 1, 1), date(2024, 2, 1)), (2, True, date(2024, 1, 2), date(2024, 1, 3)), (3, False, date(2024, 1, 1), date(2024, 2, 1))], "company_id long, enabled boolean, checked_at date, valid_until date")
    assert [r[0] for r in v2.usable_aliases(df, date(2024, 1, 3)).collect()] == [1]
    assert sorted(r[0] for r in v2.usable_aliases(df, date(2024, 1, 2)).collect()) == [1, 2]


def test_empty_portfolio_gives_nothing(spark):
    df = spark.createDataFrame([("a",)], "id string")
    assert v2.in_scope(df, "portfolio", None, []).count() == 0


def test_first_backfill_is_capped(spark):
    arts = spark.createDataFrame([(k, f"u{i:02}", datetime(2024, 1, 1) + timedelta(hours=i)) for k in (1, 2) for i in range(30)], "company_id long, url string, published_at timestamp")
    st = spark.createDataFrame([(2, datetime(2024, 1, 1))], "company_id long, last_success_at timestamp")
    got = reads.newest_first_backfill(arts, st, ["company_id"]).groupBy("company_id").count()
    assert rows(got) == [(1, 25), (2, 30)]
