"""Sources, read endpoints and the rest of the state and resolution operators."""

import hashlib
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pressline.operators import api, resolution, state, v2
from pressline.plans.model import Model
from pressline.sources import files

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ticker_news_drops_what_lacks_a_part(spark):
    data = [("h", "u", 1704067200, " ", "s", ""), ("", "u", 1, None, None, None), ("h", None, 1, None, None, None), ("h", "u", None, None, None, None), ("h", "u", 0, None, None, None)]
    df = spark.createDataFrame(data, "headline string, url string, datetime long, summary string, source string, image string")
    assert rows(files.ticker_news(df)) == [("h", "u", None, "s", datetime(2024, 1, 1), None)]


def test_entity_news_needs_the_symbol(spark):
    df = spark.createDataFrame([("a", [("aapl",)]), ("b", [("MSFT",)]), ("c", [])], "id string, entities array<struct<symbol:string>>")
    assert [r["id"] for r in files.entity_news(df, ["AAPL"]).collect()] == ["a"]


def test_query_widening(spark):
    data = [("x", a, i) for a, n in ((0, 2), (1, 7), (2, 9)) for i in range(n)] + [("y", a, i) for a, n in ((0, 2), (1, 3), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(data, "key string, attempt int, item int")
    got = files.widest_attempt(df, "key", "attempt").groupBy("key", "attempt").count()
    assert rows(got) == [("x", 1, 7), ("y", 1, 3)]


def test_atom_filings(spark):
    link = "https://www.sec.gov/Archives/edgar/data/320193/000032019324000001/x.htm"
    df = spark.createDataFrame([("8-K - Acme", link, None, "t"), ("x", link, "10-K", "t"), ("4 - Acme", link, None, "t"), ("8-K - Acme", "https://other", None, "t")], "title string, link string, category string, updated string")
    got = rows(files.atom_filings(df).select("cik", "accession", "form"))
    assert got == [("320193", "0000320193-24-000001", "10-K"), ("320193", "0000320193-24-000001", "8-K")]


def test_evidence_is_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    good = spark.createDataFrame([("a.json", hashlib.sha256(b"{}").hexdigest())], "name string, sha256 string")
    assert rows(files.evidence(spark, str(tmp_path), good)) == [("a.json", "{}")]
    for bad in ([("a.json", "0")], [("b.json", "0")]):
        with pytest.raises(files.InvalidSource):
            files.evidence(spark, str(tmp_path), spark.createDataFrame(bad, "name string, sha256 string"))


def test_sources_join_into_one_shape(spark):
    news = spark.createDataFrame([("p", "1", "h")], "provider_id string, source_id string, headline string")
    gone = spark.createDataFrame([("p", "2")], "provider_id string, source_id string")
    out = files.provider_articles(files.upserts_and_removals(news, gone))
    assert out.columns == list(files.PROVIDER_ARTICLE)
    assert rows(out.select("source_id", "action")) == [("1", "upsert"), ("2", "delete")]


def test_caps(spark):
    df = spark.createDataFrame([(" " + "h" * 2100, "s" * 20_001, "b", ["ok", "ok", "Not ok"], [])], "headline string, summary string, body string, topics array<string>, companies array<string>")
    [r] = files.capped_articles(df).collect()
    assert (len(r["headline"]), len(r["summary"]), r["topics"]) == (2000, 20_000, ["ok"])


def test_due_sources(spark):
    now = datetime(2024, 1, 2)
    base = ("p", True, True, True, 1, 5, None, now - timedelta(minutes=61), 60)
    cases = [base, (*base[:1], False, *base[2:]), (*base[:4], 5, *base[5:]), (*base[:6], "[auth] no", *base[7:]), (*base[:7], now, 60), (*base[:7], None, 60)]
    df = spark.createDataFrame(cases, "provider_id string, enabled boolean, configured boolean, display_licensed boolean, requests_today int, budget int, last_error string, last_success_at timestamp, refresh_minutes int")
    assert [r[0] for r in df.select(v2.is_due(now)).collect()] == [True, False, False, False, False, True]
    spent = spark.createDataFrame([(4, date(2024, 1, 2)), (4, date(2024, 1, 1)), (None, None)], "n int, day date")
    assert [r[0] for r in spent.select(v2.spent_today(F.col("n"), F.col("day"), date(2024, 1, 2))).collect()] == [4, 0, 0]


def test_checkpoints_resume(spark):
    jobs = spark.createDataFrame([(1, "a", "done", "x", 1), (2, "a", "failed", "y", 2), (3, "b", "failed", "z", 1), (4, "b", "done", "w", 2)], "id int, provider_id string, status string, checkpoint string, created_at int")
    provs = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("c", "pc")], "provider_id string, checkpoint string")
    assert rows(v2.resume_checkpoint(jobs, provs)) == [("a", "y"), ("b", "pb"), ("c", "pc")]


COMPANY = "id long, ticker string, company_name string, country string, exchange_hint string, resolution_status string, is_active boolean"


def test_snapshot_import(spark):
    c = spark.createDataFrame([(1, "A", "Acme", None, None, "pending", True), (2, "B", "Beta", "GB", None, "pending", True), (3, "C", "Cee", "GB", None, "resolved", True), (4, "D", "Dee", "GB", None, "pending", True)], COMPANY)
    ls = spark.createDataFrame([(4,)], "company_id long")
    snap = spark.createDataFrame([(t, n, k, None, "resolved", "LN") for t, n, k in (("A", "Acme", None), ("B", "Other", "GB"), ("C", "Cee", "GB"), ("D", "Dee", "GB"))], "ticker string, company_name string, country string, exchange_hint string, resolution_status string, exchange_code string")
    assert [r["id"] for r in state.import_snapshot(c, ls, snap).collect()] == [1]


def test_alias_seeding(spark):
    c = spark.createDataFrame([(i, t, n, "GB", None, "resolved", True) for i, t, n in ((1, "A", "Acme"), (2, "B", "Beta"), (3, "B", "Beta twin"), (4, "D", "Dee"), (5, "E", "Eve"))], COMPANY)
    ls = spark.createDataFrame([(1, "A", "XLON"), (4, "D", "XLON"), (5, "D", "XLON")], "company_id long, symbol string, mic string")
    cand = spark.createDataFrame([(k, t, "XLON", "GB", need) for k, t, need in (("a", "A", True), ("b", "B", False), ("d", "D", True), ("e", "E", True), ("e2", "E", False))], "alias_key string, ticker string, mic string, country string, requires_listing boolean")
    none = cand.limit(0)
    assert [r[0] for r in rows(state.seed_aliases(cand, c, ls, none).select("alias_key"))] == ["a", "e2"]
    assert state.seed_aliases(cand, c, ls, cand).isEmpty()


def test_vanished_lines(spark):
    old = spark.createDataFrame([(1, "LN", "A"), (1, "US", "A"), (2, "LN", "B")], "company_id long, exchange_code string, symbol string")
    found = spark.createDataFrame([(1, ["LN"], ["A"])], "company_id long, exchanges array<string>, symbols array<string>")
    assert rows(resolution.unseen_lines(old, found)) == [(1, "US", "A"), (2, "LN", "B")]


@pytest.fixture(scope="module")
def store(spark):
    m = Model(spark, SF)
    runs = m.run_rows.groupBy(F.col("run_id").alias("id")).agg(F.max("at").alias("finished_at"))
    return SimpleNamespace(companies=m.companies, listings=m.listings, articles=m.articles, links=m.links, runs=runs, run_rows=m.run_rows, v2_articles=m.v2_articles, v2_links=m.v2_links, v2_status=m.v2_status)


def test_endpoints(store):
    assert api.companies(store, status="resolved", limit=3).count() == 3
    assert [r["ticker"] for r in api.company(store, "t3").collect()] == ["T3"]
    assert api.listings(store, limit=7).count() == 7
    got = api.company_news(store, "T3", limit=5).collect()
    assert got and all(r["company_count"] <= api.COMPANY_MAX_COMPANIES for r in got)
    assert all(r["is_market_wide"] for r in api.market_news(store, limit=5).collect())
    assert api.latest_run(store).first()["id"] == 30
    assert api.run_companies(store, 3, limit=5).count() <= 5
    page = api.v2_news(store, limit=5).collect()
    assert len(page) == 6 and all(a["published_at"] >= b["published_at"] for a, b in zip(page, page[1:]))
    assert api.v2_news(store, scope="portfolio", company_ids=[]).count() == 0
    assert api.v2_article(store, page[0]["id"]).count() == 1
    assert api.status(store, "2024-02-05 00:00:00").first()["stale"]
    assert api.v2_status(store).count() == 1 and api.v2_companies(store, limit=3).count() == 4


def test_bounds(store):
    for call in (lambda: api.news(store, limit=0), lambda: api.news(store, limit=201), lambda: api.news(store, min_relevance=2), lambda: api.news(store, max_source_tier=4), lambda: api.v2_news(store, scope="x"), lambda: api.v2_article(store, "a/b"), lambda: api.companies(store, offset=-1)):
        with pytest.raises(api.BadRequest):
            call()
