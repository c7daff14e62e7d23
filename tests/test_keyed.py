"""Keyed state in buckets, and link counts kept in it: against dicts, with replays, failures and readers at work."""

import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pressline.operators import counts, reads, state
from pressline.sources import keyed

SCHEMA = "k bigint, s string, v bigint, at bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def store(spark, tmp_path, **more):
    return keyed.KeyedStore(spark, str(tmp_path / "state"), ["k", "s"], SCHEMA, **more)


def test_batches_equal_a_dict(spark, tmp_path):
    rng, want = random.Random(1), {}
    st = store(spark, tmp_path, buckets=7)
    assert rows(st.read()) == []
    for epoch in range(4):
        batch = [(rng.choice([None, *range(30)]), rng.choice(["a", None]), rng.randrange(99), epoch * 10 + rng.randrange(15)) for _ in range(40)]
        batch = list({(r[0], r[1], r[3]): r for r in batch}.values())  # no ties within a batch
        st.apply(spark.createDataFrame(batch, SCHEMA), epoch, keyed.latest(["k", "s"], "at"))
        for r in sorted(batch, key=lambda r: r[3]):
            if (r[0], r[1]) not in want or r[3] >= want[r[0], r[1]][3]:
                want[r[0], r[1]] = r
        assert rows(st.read()) == sorted(want.values(), key=str)
    again = keyed.KeyedStore(spark, str(tmp_path / "state"), ["k", "s"], SCHEMA, buckets=99)
    assert again.buckets == 7 and rows(again.read()) == rows(st.read())


def test_bytes_follow_the_batch(spark, tmp_path):
    st = store(spark, tmp_path, buckets=32)
    whole = st.apply(spark.range(20_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("s"), F.col("id").alias("v"), F.lit(0).cast("bigint").alias("at")), 0, keyed.latest(["k", "s"], "at"))
    assert whole["rewritten"] == 32
    one = spark.createDataFrame([(5, "e4da3b7fbbce2345d7772b0674a318d5", 77, 1)], SCHEMA)
    part = st.apply(one, 1, keyed.latest(["k", "s"], "at"))
    assert part["rewritten"] == 1 and part["bytes_written"] < whole["bytes_written"] / 16
    assert sum(p.split("/")[1] == whole["where"]["0"].split("/")[1] for p in part["where"].values()) >= 31
    assert st.read().count() == 20_000 and st.read().filter("k = 5").first()["v"] == 77


def test_replays_and_failures_change_nothing(spark, tmp_path, monkeypatch):
    st = store(spark, tmp_path, buckets=4)
    batch = spark.createDataFrame([(i, "a", i, 1) for i in range(10)], SCHEMA)
    st.apply(batch, 0, keyed.latest(["k", "s"], "at"))
    before = rows(st.read())
    plus = lambda old, new: old.unionByName(new.withColumn("s", F.col("s")))  # noqa: E731  (would double if it ran twice)
    assert st.apply(batch, 0, plus) is None and rows(st.read()) == before
    with monkeypatch.context() as m:  # the write is done, the manifest is not
        m.setattr(keyed.KeyedStore, "_write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            st.apply(spark.createDataFrame([(3, "a", 99, 2)], SCHEMA), 1, keyed.latest(["k", "s"], "at"))
    assert rows(st.read()) == before
    reader = st.read()  # at work while the next two batches come
    for epoch in (1, 2):
        st.apply(spark.createDataFrame([(3, "a", 90 + epoch, 1 + epoch)], SCHEMA), epoch, keyed.latest(["k", "s"], "at"))
        if epoch == 1:
            assert rows(reader) == before
    assert st.read().filter("k = 3").first()["v"] == 92
    names = os.listdir(tmp_path / "state" / "data")
    named = {p.split("/")[1] for n in os.listdir(tmp_path / "state" / "manifest") if n.endswith(".json") for p in json.load(open(tmp_path / "state" / "manifest" / n))["where"].values()}
    assert {n for n in names if not n.startswith(".")} == named  # what the killed batch left is gone


def test_rows_that_go_and_keys_of_other_buckets(spark, tmp_path):
    st = store(spark, tmp_path, buckets=16)
    st.apply(spark.createDataFrame([(i, "a", i, 1) for i in range(40)], SCHEMA), 0, keyed.latest(["k", "s"], "at"))
    st.apply(spark.createDataFrame([(i, "a", i, 2) for i in range(0, 40, 2)], SCHEMA), 1, lambda old, new: old.join(new.select("k", "s"), ["k", "s"], "left_anti").select(*old.columns))
    assert [r[0] for r in rows(st.read().orderBy("k").select("k"))] == sorted(range(1, 40, 2), key=lambda k: f"({k},)")
    with pytest.raises(ValueError, match="does not touch"):
        st.apply(spark.createDataFrame([(1, "a", 1, 3)], SCHEMA), 2, lambda old, new: spark.createDataFrame([(i, "z", 1, 1) for i in range(200)], SCHEMA))
    with pytest.raises(ValueError, match="the state has"):
        st.apply(spark.createDataFrame([(1, "a", 1, 3)], SCHEMA), 2, lambda old, new: old.select("k", "s"))
    st.apply(spark.createDataFrame([(7, "b", 1, 4)], SCHEMA), 3, lambda old, new: new, every=True)  # a batch that replaces all
    assert rows(st.read()) == [(7, "b", 1, 4)]
    st.apply(spark.createDataFrame([], SCHEMA), 4, keyed.latest(["k", "s"], "at"))
    assert rows(st.read()) == [(7, "b", 1, 4)] and st.manifest()["rewritten"] == 0


def test_a_stream_into_a_store(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, "a", 10 * i + k, i) for k in range(5 + i)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={i}")
    st = store(spark, tmp_path, buckets=4)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        keyed.run(stream, st, f"{tmp_path}/check", keyed.latest(["k", "s"], "at"))
    assert rows(st.read()) == [(k, "a", 20 + k, 2) for k in range(7)] and st.manifest()["epoch"] == 2


LINKS = "article_id bigint, company_id bigint, relevance decimal(3,2)"


def test_counts_follow_links(spark, tmp_path):
    rng, held = random.Random(2), {}
    st = keyed.KeyedStore(spark, str(tmp_path / "counts"), ["article_id"], counts.SCHEMA, 5)
    frame = lambda links: spark.createDataFrame([(a, c, r) for (a, c), r in links], LINKS)
    for epoch in range(4):
        new = {(rng.randrange(25), rng.randrange(9)): rng.choice([None, Decimal("0.60"), Decimal("0.95"), Decimal("1.00")]) for _ in range(40)}
        new = {k: v for k, v in new.items() if k not in held}
        gone = dict(rng.sample(sorted(held.items(), key=str), len(held) // 3))
        st.apply(counts.changes(frame(new.items()), frame(gone.items())), epoch, counts.fold)
        held = {k: v for k, v in held.items() if k not in gone} | new
        want = {r["article_id"]: (r["company_count"], r["best"]) for r in reads.link_counts(frame(held.items())).collect()}
        assert {r["article_id"]: (r["company_count"], r["best"]) for r in st.read().collect()} == want
    # a merge of articles moves links: the difference of their links before and after
    after = {(0 if a < 3 else a, c): r for (a, c), r in sorted(held.items(), key=lambda x: -x[0][0])}
    touched = lambda links: frame((k, v) for k, v in links.items() if k[0] < 3)
    st.apply(counts.merged_links(touched(held), touched(after)), 9, counts.fold)
    assert {r["article_id"]: (r["company_count"], r["best"]) for r in st.read().collect()} == {r["article_id"]: (r["company_count"], r["best"]) for r in reads.link_counts(frame(after.items())).collect()}


def test_a_feed_by_counts_reads_no_other_aggregate(spark):
    links = spark.createDataFrame([(1, 1, "ticker", Decimal("0.90"), Decimal("0.80"))], "article_id bigint, company_id bigint, match_method string, confidence decimal(3,2), relevance decimal(3,2)")
    articles = spark.createDataFrame([(1, None)], "id bigint, published_at timestamp")
    companies = spark.createDataFrame([(1, "T", "Name", True)], "id bigint, ticker string, company_name string, is_active boolean")
    kept = counts.fold(spark.createDataFrame([], counts.SCHEMA), counts.changes(links)).select("article_id", "company_count", "best")
    args = dict(min_relevance=0.5, max_companies=3)
    with_counts, without = (reads.list_news(links, articles, companies, counts=c, **args) for c in (kept, None))
    assert with_counts.select("id", "company_count", "relevance").collect() == without.select("id", "company_count", "relevance").collect()


def test_market_links(spark):
    batch = spark.createDataFrame([("n", "Acme Widgets gains", ["ABC", "ZZZ"]), ("n", "Acme Widgets gains", ["ABC"]), ("old", "Nothing here", ["DEF"]), ("none", "acme alone", []), ("null", None, None)], "dedupe_hash string, headline string, related array<string>")
    companies = spark.createDataFrame([(1, "Acme Widgets Inc"), (2, "Beta Corp"), (3, "Gamma Ltd")], "id bigint, company_name string")
    symbols = spark.createDataFrame([("ABC", 2), ("DEF", 3)], "symbol string, company_id bigint")
    links = spark.createDataFrame([("old", 3)], "dedupe_hash string, company_id bigint")
    got = state.market_links(batch, symbols, companies, links)
    assert rows(got) == [("n", 1, "name_match", Decimal("0.70"), Decimal("0.60"), state.MARKET_REASON), ("n", 2, "name_match", Decimal("0.70"), Decimal("0.60"), state.MARKET_REASON)]
