"""Read-model queries and their oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pressline.operators import reads, v2
from pressline.plans.model import AS_OF, Model, sql

_FEED = """SELECT a.id, strftime(a.published_at, '%Y-%m-%d') AS day, CAST(coalesce(c.n, 0) AS BIGINT) AS company_count,
  CAST(greatest(0, round(coalesce(c.best, 0.9) - CASE WHEN c.n >= 8 THEN 0.35 WHEN c.n >= 4 THEN 0.15 ELSE 0 END, 2)) AS DOUBLE) AS relevance,
  coalesce((SELECT string_agg(ticker, ',' ORDER BY confidence DESC, ticker) FROM links l2 JOIN companies c2 ON c2.id = l2.company_id WHERE l2.article_id = a.id AND c2.is_active), '') AS tickers
FROM m JOIN articles a USING (id) LEFT JOIN (SELECT article_id, count(*) AS n, max(relevance) AS best FROM links GROUP BY 1) c ON c.article_id = a.id"""


def _match(where: str) -> str:
    return f"""WITH k AS (SELECT article_id, count(*) AS n FROM links GROUP BY 1),
m AS (SELECT DISTINCT a.id, a.published_at FROM links l JOIN articles a ON a.id = l.article_id JOIN companies c ON c.id = l.company_id JOIN k ON k.article_id = a.id
  WHERE c.is_active {where} ORDER BY a.published_at DESC, a.id DESC LIMIT 50)
"""


def _flat(feed):
    return feed.select("id", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.col("company_count").cast("long").alias("company_count"), "relevance", F.array_join(F.transform("companies", lambda c: c["ticker"]), ",").alias("tickers"))


def _feed(**filters):
    def query(spark, sf_dir):
        m = Model(spark, sf_dir)
        return _flat(reads.list_news(m.links, m.articles, m.companies, **filters))

    return query


def _company_list(spark, sf_dir):
    m = Model(spark, sf_dir)
    out = reads.company_filter(m.companies, m.listings, q="supplier#0000000", exchange="ln", us_listed=True, status="resolved")
    return out.select("id", "ticker", "company_name", "country")


def _company_detail(spark, sf_dir):
    m = Model(spark, sf_dir)
    out = reads.company_detail(m.companies.filter("is_active"), m.listings, m.links, m.articles)
    first = F.transform(F.slice("listings", 1, 5), lambda x: x["symbol"])
    return out.select("id", "ticker", F.coalesce(F.size("listings"), F.lit(0)).cast("long").alias("n_listings"), F.coalesce(F.array_join(first, ","), F.lit("")).alias("first_symbols"), F.col("article_count").cast("long").alias("article_count"), F.date_format("latest_article_at", "yyyy-MM-dd").alias("latest_day"))


def _mapping(spark, sf_dir):
    m = Model(spark, sf_dir)
    return reads.listing_mapping(m.companies, m.listings).select("catalogue_ticker", "company_name", "exchange_hint", "resolution_status", "listing_id", "exchange_code", "symbol", "is_primary", "is_us", F.col("confidence").cast("double").alias("confidence"))


def _mapping_page(spark, sf_dir):
    m = Model(spark, sf_dir)
    return reads.listing_mapping(m.companies, m.listings, limit=100, offset=50).select("catalogue_ticker", "listing_id")


def _market(spark, sf_dir):
    m = Model(spark, sf_dir)
    out = reads.market_news(m.articles, m.links, m.companies, max_source_tier=2, limit=50)
    return out.select("id", "source_tier", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.array_join("tickers", ",").alias("tickers"))


def _counts(spark, sf_dir):
    m = Model(spark, sf_dir)
    return reads.service_counts(m.companies, m.listings, m.articles, m.links)


def _news_total(spark, sf_dir):
    m = Model(spark, sf_dir)
    return reads.count_news(m.links, m.articles, m.companies, match_method="ticker", min_confidence=0.52)


def _velocity(spark, sf_dir):
    m = Model(spark, sf_dir)
    state = m.companies.filter("id % 3 <> 0").select(F.col("id").alias("company_id"))
    as_of = F.lit(AS_OF).cast("timestamp")
    return reads.velocity(m.companies, m.links, m.articles, state, as_of).select("id", F.col("recent").cast("long").alias("recent"), "hot", "active", "quiet")


def _candidates(spark, sf_dir):
    m = Model(spark, sf_dir)
    few = m.links.withColumn("company_id", F.col("company_id") - (F.col("company_id") % 4 == 0).cast("int"))
    return reads.fetch_candidates(m.companies, m.listings.filter("is_primary"), few, limit=30).select("id", "has_news", "symbols")


def _unmatched(spark, sf_dir):
    m = Model(spark, sf_dir)
    asked = m.companies.select(F.lower("ticker").alias("ticker")).unionByName(m.table("nation").select(F.col("n_name").alias("ticker")))
    return reads.unmatched_requests(asked, m.companies, m.companies.filter("resolution_status = 'resolved'"))


def _live(m):
    return v2.entitled(m.v2_articles.filter("NOT deleted"), m.v2_status)


def _readable(spark, sf_dir):
    return _live(Model(spark, sf_dir)).filter(v2.is_readable()).select("id", "provider_id")


def _macro(spark, sf_dir):
    m = Model(spark, sf_dir)
    return v2.in_scope(_live(m), "macro").select("id")


def _portfolio(spark, sf_dir):
    m = Model(spark, sf_dir)
    return v2.in_scope(_live(m), "portfolio", m.v2_links, [2, 3]).filter(v2.has_topic("markets") & v2.mentions("an_")).select("id")


def _keyset(spark, sf_dir):
    page = v2.keyset_page(_live(Model(spark, sf_dir)), 40, ("2024-02-10 00:00:00", "000000500"))
    return page.select("id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


def _directory(spark, sf_dir):
    return v2.directory_page(Model(spark, sf_dir).companies, 20, 15).select("id", "ticker")


def _display(spark, sf_dir):
    m = Model(spark, sf_dir)
    return v2.displayed(v2.entitled(m.v2_articles, m.v2_status)).select("id", "preview_text", F.col("reading_minutes").cast("long").alias("reading_minutes"), "content_mode", "source_kind", "image_url")


def _provider_status(spark, sf_dir):
    """Providers with their settings (every sixth has none), requests of today or of the day before, and live articles."""
    m = Model(spark, sf_dir)
    known = m.v2_status.withColumn("n", F.regexp_extract("provider_id", "([0-9]+)$", 1).cast("int"))
    config = known.select(F.when(F.col("n") % 6 == 0, "nobody").otherwise(F.col("provider_id")).alias("provider_id"), "enabled", "configured", "display_licensed", "full_text_enabled")
    day = F.when(F.col("n") % 2 == 0, F.lit("2024-01-15")).otherwise("2024-01-14").cast("date")
    state = known.select("provider_id", (F.col("n") * 3).alias("requests_today"), day.alias("budget_day"))
    out = v2.provider_status(known.select("provider_id", "free"), config.filter("provider_id <> 'nobody'"), state, m.v2_articles, date(2024, 1, 15))
    return out.select("provider_id", "enabled", "configured", "free", "requests_today", "articles")


def _coverage_summary(spark, sf_dir):
    m = Model(spark, sf_dir)
    out = v2.coverage_summary(m.v2_articles, m.v2_links)
    return out.select("articles", "providers", "companies", F.date_format("oldest", "yyyy-MM-dd HH:mm").alias("oldest"), F.date_format("newest", "yyyy-MM-dd HH:mm").alias("newest"))


_ENTITLED = "v2 a JOIN v2_status s USING (provider_id) WHERE s.enabled AND s.configured"
_TAIL = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_FLATTEN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"

QUERIES = {
    "feed_company_news": (_feed(ticker="t3", max_source_tier=2), sql(_match("AND upper(c.ticker) = 'T3' AND a.source_tier <= 2") + _FEED, "companies", "articles", "links")),
    "feed_cross_company": (_feed(provider="F", match_method="ticker", min_confidence=0.55), sql(_match("AND a.provider = 'F' AND l.match_method = 'ticker' AND l.confidence >= 0.55") + _FEED, "companies", "articles", "links")),
    "feed_market_wide": (_feed(market_wide=True, start="1996-01-01 00:00:00", end="1999-12-31 00:00:00"), sql(_match("AND a.is_market_wide AND a.published_at >= TIMESTAMP '1996-01-01' AND a.published_at <= TIMESTAMP '1999-12-31'") + _FEED, "companies", "articles", "links")),
    "feed_max_companies": (_feed(max_companies=2), sql(_match("AND k.n <= 2") + _FEED, "companies", "articles", "links")),
    "feed_min_relevance": (_feed(min_relevance=0.8), sql(_match("AND l.relevance - CASE WHEN k.n >= 8 THEN 0.35 WHEN k.n >= 4 THEN 0.15 ELSE 0 END >= 0.8") + _FEED, "companies", "articles", "links")),
    "feed_total": (_news_total, sql("SELECT count(DISTINCT l.article_id) AS total FROM links l JOIN articles a ON a.id = l.article_id JOIN companies c ON c.id = l.company_id WHERE c.is_active AND l.match_method = 'ticker' AND l.confidence >= 0.52", "companies", "articles", "links")),
    "market_news_page": (_market, sql("""WITH m AS (SELECT * FROM articles WHERE is_market_wide AND source_tier <= 2 ORDER BY published_at DESC, id DESC LIMIT 50)
SELECT id, source_tier, strftime(published_at, '%Y-%m-%d') AS day, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM links l JOIN companies c ON c.id = l.company_id WHERE l.article_id = m.id AND c.is_active), '') AS tickers FROM m""", "companies", "articles", "links")),
    "company_list_filtered": (_company_list, sql("""SELECT id, ticker, company_name, country FROM companies c WHERE is_active AND resolution_status = 'resolved' AND (contains(lower(company_name), 'supplier#0000000') OR contains(lower(ticker), 'supplier#0000000'))
  AND EXISTS (SELECT 1 FROM listings l WHERE l.company_id = c.id AND upper(exchange_code) = 'LN') AND EXISTS (SELECT 1 FROM listings l WHERE l.company_id = c.id AND is_us)""", "companies", "listings")),
    "company_detail": (_company_detail, sql("""WITH o AS (SELECT company_id, symbol, row_number() OVER (PARTITION BY company_id ORDER BY is_primary DESC, confidence DESC, exchange_code, id) AS r FROM listings)
SELECT c.id, c.ticker, (SELECT count(*) FROM listings l WHERE l.company_id = c.id) AS n_listings, coalesce((SELECT string_agg(symbol, ',' ORDER BY r) FROM o WHERE o.company_id = c.id AND r <= 5), '') AS first_symbols,
  (SELECT count(*) FROM links l WHERE l.company_id = c.id) AS article_count, (SELECT strftime(max(published_at), '%Y-%m-%d') FROM links l JOIN articles a ON a.id = l.article_id WHERE l.company_id = c.id) AS latest_day
FROM companies c WHERE c.is_active""", "companies", "listings", "links", "articles")),
    "listing_mapping": (_mapping, sql("SELECT c.ticker AS catalogue_ticker, c.company_name, c.exchange_hint, c.resolution_status, l.id AS listing_id, l.exchange_code, l.symbol, l.is_primary, l.is_us, CAST(l.confidence AS DOUBLE) AS confidence FROM companies c LEFT JOIN listings l ON l.company_id = c.id WHERE c.is_active", "companies", "listings")),
    "listing_mapping_page": (_mapping_page, sql("SELECT c.ticker AS catalogue_ticker, l.id AS listing_id FROM companies c LEFT JOIN listings l ON l.company_id = c.id WHERE c.is_active ORDER BY c.ticker, l.is_primary DESC NULLS LAST, l.confidence DESC NULLS LAST, l.id LIMIT 100 OFFSET 50", "companies", "listings")),
    "service_counts": (_counts, sql("""SELECT (SELECT count(*) FROM companies WHERE is_active) AS companies, (SELECT count(*) FROM companies WHERE is_active AND resolution_status = 'resolved') AS companies_resolved,
  (SELECT count(*) FROM companies WHERE is_active AND resolution_status <> 'resolved') AS companies_unresolved, (SELECT count(*) FROM listings) AS listings, (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM links) AS article_links""", "companies", "listings", "articles", "links")),
    "refresh_tier_membership": (_velocity, sql(f"""WITH r AS (SELECT company_id, count(*) AS n FROM links l JOIN articles a ON a.id = l.article_id WHERE published_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND published_at <= TIMESTAMP '{AS_OF}' GROUP BY 1),
v AS (SELECT id, coalesce(n, 0) AS recent, id % 3 <> 0 AS fetched FROM companies LEFT JOIN r ON r.company_id = id WHERE is_active)
SELECT id, recent, recent >= 21 AS hot, (recent BETWEEN 3 AND 20) OR NOT fetched AS active, recent <= 2 AND fetched AS quiet FROM v""", "companies", "links", "articles")),
    "fetch_candidates_unserved_first": (_candidates, sql("""SELECT c.id, EXISTS (SELECT 1 FROM links l WHERE l.company_id - CAST(l.company_id % 4 = 0 AS INTEGER) = c.id) AS has_news,
  (SELECT string_agg(symbol, ',' ORDER BY is_primary DESC, confidence DESC, id) FROM listings s WHERE s.company_id = c.id AND is_primary) AS symbols
FROM companies c WHERE is_active AND resolution_status = 'resolved' ORDER BY has_news, id LIMIT 30""", "companies", "listings", "links")),
    "unmatched_requests": (_unmatched, sql("""WITH q AS (SELECT lower(ticker) AS ticker FROM companies UNION ALL SELECT n_name FROM nation)
SELECT ticker, CASE WHEN upper(ticker) NOT IN (SELECT upper(ticker) FROM companies) THEN 'not_in_catalogue' ELSE 'excluded_by_tier' END AS reason FROM q
WHERE upper(ticker) NOT IN (SELECT upper(ticker) FROM companies WHERE resolution_status = 'resolved')""", "companies")),
    "feed_readable_only": (_readable, sql(f"""SELECT a.id, a.provider_id FROM {_ENTITLED} AND NOT deleted
  AND (((s.free OR s.full_text_enabled) AND body_allowed AND length(trim(coalesce(body, ''))) > 0)
    OR (length(trim(coalesce(summary, ''))) >= 80 AND length(replace({_TAIL.format('summary')}, {_TAIL.format('headline')}, '')) >= 40))""", "v2", "v2_status")),
    "feed_scope_macro": (_macro, sql(f"SELECT a.id FROM {_ENTITLED} AND NOT deleted AND (genre = 'macro' OR list_has_any(topics, ['monetary-policy', 'inflation']))", "v2", "v2_status")),
    "feed_portfolio_topic_search": (_portfolio, sql(f"SELECT a.id FROM {_ENTITLED} AND NOT deleted AND list_contains(topics, 'markets') AND (headline ILIKE '%an_%' OR summary ILIKE '%an_%') AND a.id IN (SELECT article_id FROM v2_links WHERE company_id IN (2, 3))", "v2", "v2_status", "v2_links")),
    "feed_keyset_page": (_keyset, sql(f"""SELECT a.id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM {_ENTITLED} AND NOT deleted
  AND (published_at < TIMESTAMP '2024-02-10' OR (published_at = TIMESTAMP '2024-02-10' AND a.id < '000000500')) ORDER BY published_at DESC, a.id DESC LIMIT 41""", "v2", "v2_status")),
    "directory_page": (_directory, sql("SELECT id, ticker FROM companies WHERE is_active AND id > 15 ORDER BY id LIMIT 21", "companies")),
    "article_display": (_display, sql(f"""WITH d AS (SELECT a.*, s.free, CASE WHEN body_allowed AND (s.free OR s.full_text_enabled) THEN body END AS b FROM {_ENTITLED}),
p AS (SELECT *, {_FLATTEN.format('CASE WHEN NOT deleted THEN coalesce(b, summary) END')} AS t FROM d),
q AS (SELECT *, CASE WHEN contains(substr(t, 1, 700), ' ') THEN length(substr(t, 1, 700)) - strpos(reverse(substr(t, 1, 700)), ' ') ELSE -1 END AS sp FROM p)
SELECT id, CASE WHEN length(t) = 0 THEN NULL WHEN length(t) <= 700 THEN t ELSE rtrim(substr(t, 1, CASE WHEN sp > 500 THEN sp ELSE 699 END)) || '…' END AS preview_text,
  CASE WHEN NOT deleted AND length(b) > 0 THEN greatest(1, CAST(ceil(len(string_split({_FLATTEN.format('b')}, ' ')) / 200.0) AS BIGINT)) END AS reading_minutes,
  CASE WHEN deleted THEN 'link_only' WHEN b <> '' THEN 'full_text' WHEN summary IS NOT NULL THEN 'summary' ELSE 'link_only' END AS content_mode,
  CASE WHEN free THEN 'official' ELSE 'aggregator' END AS source_kind, CASE WHEN image_allowed AND NOT deleted THEN 'https://img.example.org/' || doc_id || '.png' END AS image_url FROM q""", "v2", "v2_status")),
    "provider_status": (_provider_status, sql("""WITH n AS (SELECT *, CAST(regexp_extract(provider_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM v2_status)
SELECT provider_id, enabled AND n % 6 <> 0 AS enabled, configured AND n % 6 <> 0 AS configured, free, CASE WHEN n % 2 = 0 THEN n * 3 ELSE 0 END AS requests_today,
  (SELECT count(*) FROM v2 WHERE v2.provider_id = n.provider_id AND NOT deleted) AS articles FROM n""", "v2", "v2_status")),
    "coverage_summary": (_coverage_summary, sql("SELECT count(*) AS articles, count(DISTINCT provider_id) AS providers, (SELECT count(DISTINCT company_id) FROM v2_links) AS companies, strftime(min(published_at), '%Y-%m-%d %H:%M') AS oldest, strftime(max(published_at), '%Y-%m-%d %H:%M') AS newest FROM v2 WHERE NOT deleted", "v2", "v2_links")),
}


def flagship(spark, sf_dir):
    return QUERIES["feed_company_news"][0](spark, sf_dir)
