"""One function per read endpoint: same parameters, defaults and bounds, a DataFrame as result.

``store`` is any object with the entity frames as attributes (companies, listings, articles,
links, runs, run_rows, v2_articles, v2_links, v2_status).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.functions.control import decode_cursor
from pressline.operators import analytics, reads, v2

COMPANY_MAX_COMPANIES = 3


class BadRequest(ValueError):
    pass


def _page(limit: int, offset: int, most: int) -> None:
    if not 1 <= limit <= most or offset < 0:
        raise BadRequest(f"limit is 1 to {most}, offset 0 or more")


def _share(value, name: str) -> None:
    if value is not None and not 0 <= value <= 1:
        raise BadRequest(f"{name} is between 0 and 1")


def companies(store, *, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """q, country, exchange, us_listed, status."""
    _page(limit, offset, 500)
    page = reads.company_filter(store.companies, store.listings, **filters).orderBy("ticker").offset(offset).limit(limit)
    mine = lambda df: df.join(page.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    return reads.company_detail(page, mine(store.listings), mine(store.links), store.articles)


def company(store, ticker: str) -> DataFrame:
    one = store.companies.filter("is_active").filter(reads.same_ticker(F.col("ticker"), ticker))
    mine = lambda df: df.join(one.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    return reads.company_detail(one, mine(store.listings), mine(store.links), store.articles)


def listings(store, *, limit: int = 500, offset: int = 0) -> DataFrame:
    _page(limit, offset, 5000)
    return reads.listing_mapping(store.companies, store.listings, limit, offset)


def news(store, *, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """start, end, provider, match_method, min_confidence, market_wide, max_source_tier, min_relevance, max_companies."""
    _page(limit, offset, 200)
    _share(filters.get("min_confidence"), "min_confidence")
    _share(filters.get("min_relevance"), "min_relevance")
    if filters.get("max_source_tier") not in (None, 1, 2, 3):
        raise BadRequest("max_source_tier is 1, 2 or 3")
    return reads.list_news(store.links, store.articles, store.companies, limit=limit, offset=offset, **filters)


def company_news(store, ticker: str, *, max_companies: int | None = COMPANY_MAX_COMPANIES, **filters) -> DataFrame:
    """News of one company, by default without round-ups."""
    return news(store, ticker=ticker, max_companies=max_companies, **filters)


def market_news(store, *, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """start, end, max_source_tier."""
    _page(limit, offset, 200)
    return reads.market_news(store.articles, store.links, store.companies, limit=limit, offset=offset, **filters)


def status(store, as_of) -> DataFrame:
    """Totals, and how old the last run is."""
    return reads.service_counts(store.companies, store.listings, store.articles, store.links).crossJoin(analytics.staleness(store.runs, as_of))


def runs(store, *, limit: int = 20) -> DataFrame:
    _page(limit, 0, 200)
    return store.runs.orderBy(F.col("id").desc()).limit(limit)


def latest_run(store) -> DataFrame:
    return runs(store, limit=1)


def run(store, run_id: int) -> DataFrame:
    return store.runs.filter(F.col("id") == run_id)


def run_companies(store, run_id: int, *, outcome: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    _page(limit, offset, 2000)
    return analytics.run_company_rows(store.run_rows, store.companies, run_id, outcome, limit, offset)


def v2_news(store, *, scope: str = "all", source: str = "all", company_ids: list | None = None, topic: str | None = None, q: str | None = None, cursor: str | None = None, limit: int = 20) -> DataFrame:
    """limit + 1 displayed articles, without bodies; the last one only shows that there are more."""
    _page(limit, 0, 100)
    if scope not in ("all", "company", "portfolio", "macro"):
        raise BadRequest("unknown scope")
    live = v2.entitled(store.v2_articles.filter("NOT deleted"), store.v2_status, source).filter(v2.is_readable())
    live = v2.in_scope(live, scope, store.v2_links, company_ids)
    if topic:
        live = live.filter(v2.has_topic(topic))
    if q:
        live = live.filter(v2.mentions(q))
    return v2.displayed(v2.keyset_page(live, limit, decode_cursor(cursor, source)))


def v2_article(store, article_id: str) -> DataFrame:
    """One article with its text where that may be shown; a withdrawn one is masked, one of a source that is off is not there."""
    if not re.fullmatch(r"[0-9A-Za-z:-]{1,64}", article_id):
        raise BadRequest("invalid article identifier")
    one = v2.entitled(store.v2_articles.filter(F.col("id") == article_id), store.v2_status)
    may = F.coalesce(F.col("rights.bodyAllowed") & (F.col("free") | F.col("full_text_enabled")) & ~F.col("deleted"), F.lit(False))
    return v2.displayed(one).join(one.select("id", F.when(may, F.col("body")).alias("body")), "id")


def v2_companies(store, *, after: int | None = None, limit: int = 100) -> DataFrame:
    _page(limit, 0, 500)
    return v2.directory_page(store.companies, limit, after)


def resolve_companies(store, hints: DataFrame) -> DataFrame:
    return v2.resolve_hints(hints, store.companies, store.listings)


def v2_providers(store) -> DataFrame:
    live = store.v2_articles.filter("NOT deleted").groupBy("provider_id").agg(F.count(F.lit(1)).alias("articles"))
    return store.v2_status.join(live, "provider_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


def v2_status(store) -> DataFrame:
    return v2.coverage_summary(store.v2_articles, store.v2_links)
