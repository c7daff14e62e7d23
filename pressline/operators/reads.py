"""Read models: company list, news feeds, market news, listing mapping, service counts.

Frames have the columns of :mod:`pressline.schemas`.  Pages are cut before children are
attached, so only a page's rows are joined with links and companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import relevance

# ---------------------------------------------------------------- filters


def company_filter(companies: DataFrame, listings: DataFrame, *, q=None, country=None, exchange=None, us_listed=None, status=None) -> DataFrame:
    """Active companies under all filters that are given; q is a literal substring of name or ticker."""
    out = companies.filter("is_active")
    if q:
        out = out.filter(F.lower("company_name").contains(q.lower()) | F.lower("ticker").contains(q.lower()))
    if country:
        out = out.filter(F.col("country") == country.upper())
    if status:
        out = out.filter(F.col("resolution_status") == status)
    if exchange:
        out = out.join(listings.filter(F.upper("exchange_code") == exchange.upper()).select(F.col("company_id").alias("id")), "id", "left_semi")
    if us_listed is not None:
        out = out.join(listings.filter("is_us").select(F.col("company_id").alias("id")), "id", "left_semi" if us_listed else "left_anti")
    return out


def same_ticker(column: Column, ticker: str) -> Column:
    return F.upper(column) == ticker.upper()


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter that a missing value switches off."""
    return df if value is None else df.filter(F.col(column) == value)


def one_of(df: DataFrame, column: str, values: DataFrame | list, keep: bool = True) -> DataFrame:
    """Membership in a list, or in the one column of a frame where the list is long."""
    if isinstance(values, list):
        return df.filter(F.col(column).isin(*values) if keep else ~F.col(column).isin(*values))
    return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi" if keep else "left_anti")


def link_counts(links: DataFrame) -> DataFrame:
    """article_id, company_count and best stored relevance over all links, also those of inactive companies."""
    return links.groupBy("article_id").agg(F.count(F.lit(1)).alias("company_count"), F.max("relevance").alias("best"))


def news_matches(links: DataFrame, articles: DataFrame, companies: DataFrame, *, ticker=None, start=None, end=None, provider=None, match_method=None, min_confidence=None, market_wide=None, max_source_tier=None, min_relevance=None, max_companies=None, counts=None) -> DataFrame:
    """Distinct (id, published_at) of articles with a link that meets every filter at once; counts are maintained ones (operators.counts), else they are made from all links."""
    who = companies.filter("is_active")
    if ticker:
        who = who.filter(same_ticker(F.col("ticker"), ticker))
    a, ln = articles, links
    if start is not None:
        a = a.filter(F.col("published_at") >= F.lit(start))
    if end is not None:
        a = a.filter(F.col("published_at") <= F.lit(end))
    a = optional(a, "provider", provider)
    a = optional(a, "is_market_wide", market_wide)
    if max_source_tier is not None:
        a = a.filter(F.col("source_tier") <= max_source_tier)
    ln = optional(ln, "match_method", match_method)
    if min_confidence is not None:
        ln = ln.filter(F.col("confidence") >= F.lit(min_confidence).cast("decimal(3,2)"))
    if max_companies is not None or min_relevance is not None:
        ln = ln.join((link_counts(links) if counts is None else counts).select("article_id", "company_count"), "article_id")
        if max_companies is not None:
            ln = ln.filter(F.col("company_count") <= max_companies)
        if min_relevance is not None:
            ln = ln.filter(F.col("relevance").cast("decimal(4,2)") - relevance.roundup_penalty(F.col("company_count")) >= F.lit(min_relevance).cast("decimal(4,2)"))
    hit = ln.join(who.select(F.col("id").alias("company_id")), "company_id", "left_semi").select(F.col("article_id").alias("id")).distinct()
    return a.join(hit, "id", "left_semi").select("id", "published_at")


def newest(df: DataFrame, limit: int, offset: int = 0, ts: str = "published_at", key: str = "id") -> DataFrame:
    """A page in the total order (time, key), newest first."""
    page = df.orderBy(F.col(ts).desc(), F.col(key).desc())
    return (page.offset(offset) if offset else page).limit(limit)


def with_companies(page: DataFrame, articles: DataFrame, links: DataFrame, companies: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The page's articles with active companies (by confidence, then ticker), company_count over all links, and effective relevance."""
    mine = links.join(page.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    counts = link_counts(mine) if counts is None else counts.join(page.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("article_id", "company_count", "best")
    active = companies.filter("is_active").select(F.col("id").alias("company_id"), "ticker", "company_name")
    named = mine.join(active, "company_id").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "ticker", "company_name", "match_method", "confidence"))).alias("companies"))
    named = named.withColumn("companies", F.transform("companies", lambda c: c.dropFields("k")))
    rows = articles.join(page.select("id"), "id", "left_semi")
    out = rows.join(counts, rows["id"] == counts["article_id"], "left").drop("article_id")
    out = out.join(named, out["id"] == named["article_id"], "left").drop("article_id")
    return out.withColumns({"company_count": F.coalesce("company_count", F.lit(0)), "relevance": relevance.effective_relevance(F.col("best"), F.coalesce("company_count", F.lit(0))), "companies": F.coalesce("companies", F.expr("cast(array() as array<struct<ticker:string,company_name:string,match_method:string,confidence:decimal(3,2)>>)"))}).drop("best")


def list_news(links, articles, companies, *, limit=50, offset=0, counts=None, **filters) -> DataFrame:
    return with_companies(newest(news_matches(links, articles, companies, counts=counts, **filters), limit, offset), articles, links, companies, counts)


def count_news(links, articles, companies, **filters) -> DataFrame:
    return news_matches(links, articles, companies, **filters).agg(F.count(F.lit(1)).alias("total"))


def market_news(articles, links, companies, *, start=None, end=None, max_source_tier=None, limit=50, offset=0) -> DataFrame:
    """Market-wide stories, also those without any link; tickers of their active companies in order."""
    a = articles.filter("is_market_wide")
    if start is not None:
        a = a.filter(F.col("published_at") >= F.lit(start))
    if end is not None:
        a = a.filter(F.col("published_at") <= F.lit(end))
    if max_source_tier is not None:
        a = a.filter(F.col("source_tier") <= max_source_tier)
    page = newest(a, limit, offset)
    active = companies.filter("is_active").select(F.col("id").alias("company_id"), "ticker")
    named = links.join(page.select(F.col("id").alias("article_id")), "article_id", "left_semi").join(active, "company_id").groupBy("article_id").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    return page.join(named, page["id"] == named["article_id"], "left").drop("article_id").withColumn("tickers", F.coalesce("tickers", F.expr("cast(array() as array<string>)")))


def company_detail(companies, listings, links, articles) -> DataFrame:
    """Companies with ordered listings, number of linked articles and the latest of them."""
    order = F.struct((~F.col("is_primary")).alias("k1"), (-F.col("confidence")).alias("k2"), "exchange_code", "id", "symbol", "mic", "is_us", "is_primary", "confidence")
    mine = listings.groupBy("company_id").agg(F.array_sort(F.collect_list(order)).alias("listings"))
    mine = mine.withColumn("listings", F.transform("listings", lambda x: x.dropFields("k1", "k2")))
    seen = links.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id", "left").groupBy("company_id").agg(F.count(F.lit(1)).alias("article_count"), F.max("published_at").alias("latest_article_at"))
    out = companies.join(mine, companies["id"] == mine["company_id"], "left").drop("company_id")
    out = out.join(seen, out["id"] == seen["company_id"], "left").drop("company_id")
    return out.withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def listing_mapping(companies, listings, limit=None, offset=0) -> DataFrame:
    """Active companies with each of their listings (or none), in a total order."""
    c = companies.filter("is_active").select(F.col("id").alias("company_id"), F.col("ticker").alias("catalogue_ticker"), "company_name", "exchange_hint", "resolution_status")
    ls = listings.select("company_id", F.col("id").alias("listing_id"), "exchange_code", "mic", "symbol", "is_primary", "is_us", "confidence")
    out = c.join(ls, "company_id", "left")
    if limit is None:
        return out
    return out.orderBy("catalogue_ticker", F.col("is_primary").desc_nulls_last(), F.col("confidence").desc_nulls_last(), "listing_id").offset(offset).limit(limit)


#: Columns of the mapping's export beside the catalogue's; those that a source of listings lacks are null.
EXPORTED = ("exchange_code", "mic", "symbol", "symbol_format", "security_kind", "listing_country", "currency", "figi", "share_class_figi", "isin", "is_primary", "is_us", "confidence", "source")


def listing_export(companies, listings) -> DataFrame:
    """The whole mapping with all columns of its export, in its order: active companies by ticker, primary and certain lines first."""
    held = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    c = companies.filter("is_active").select(F.col("id").alias("company_id"), F.col("ticker").alias("catalogue_ticker"), "company_name", held(companies, "country").alias("catalogue_country"), held(companies, "exchange_hint").alias("catalogue_exchange_hint"), held(companies, "is_us_listed").alias("catalogue_is_us_listed"), "resolution_status", held(companies, "resolution_note"))
    ls = listings.withColumnRenamed("country", "listing_country").select("company_id", F.col("id").alias("listing_id"), *(held(listings.withColumnRenamed("country", "listing_country"), x) for x in EXPORTED))
    out = c.join(ls, "company_id", "left").orderBy("catalogue_ticker", F.col("is_primary").desc_nulls_last(), F.col("confidence").desc_nulls_last(), "listing_id")
    return out.drop("company_id", "listing_id")


def service_counts(companies, listings, articles, links) -> DataFrame:
    """One row of totals; a scan of each table, joined as single rows."""
    n = F.count(F.lit(1))
    c = companies.filter("is_active").agg(n.alias("companies"), F.count_if(F.col("resolution_status") == "resolved").alias("companies_resolved"), F.count_if(F.col("resolution_status") != "resolved").alias("companies_unresolved"))
    return c.crossJoin(listings.agg(n.alias("listings"))).crossJoin(articles.agg(n.alias("articles"))).crossJoin(links.agg(n.alias("article_links")))


def pending(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Active companies that wait for resolution, by id."""
    out = companies.filter("is_active AND resolution_status = 'pending'").orderBy("id")
    return out if limit is None else out.limit(limit)


def rejected_report(companies: DataFrame, limit: int = 15) -> DataFrame:
    return companies.filter(F.col("resolution_note").startswith("rejected")).orderBy("ticker").limit(limit)


def velocity(companies, links, articles, state, as_of) -> DataFrame:
    """recent (links of articles of the last 7 days), fetched, and the three tier flags, which overlap."""
    fresh = articles.filter((F.col("published_at") > F.lit(as_of) - F.expr("INTERVAL 7 DAYS")) & (F.col("published_at") <= F.lit(as_of))).select(F.col("id").alias("article_id"))
    recent = links.join(fresh, "article_id", "left_semi").groupBy("company_id").agg(F.count(F.lit(1)).alias("recent"))
    out = companies.filter("is_active").join(recent, companies["id"] == recent["company_id"], "left").drop("company_id")
    got = state.select("company_id").distinct().withColumn("fetched", F.lit(True))
    out = out.join(got, out["id"] == got["company_id"], "left").drop("company_id").withColumns({"recent": F.coalesce("recent", F.lit(0)), "fetched": F.coalesce("fetched", F.lit(False))})
    return out.withColumns({"hot": F.col("recent") >= 21, "active": F.col("recent").between(3, 20) | ~F.col("fetched"), "quiet": (F.col("recent") <= 2) & F.col("fetched")})


def fetch_candidates(companies, listings, links, limit=None) -> DataFrame:
    """Companies to fetch, those without any news first, then by id, with their listings in order."""
    served = links.select(F.col("company_id").alias("id")).distinct().withColumn("has_news", F.lit(True))
    kept = listings.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("k1"), (-F.col("confidence")).alias("k2"), "id", "symbol"))).alias("ls"))
    out = companies.filter("is_active AND resolution_status = 'resolved'").join(served, "id", "left").withColumn("has_news", F.coalesce("has_news", F.lit(False)))
    out = out.join(kept, out["id"] == kept["company_id"], "left").drop("company_id").withColumn("symbols", F.array_join(F.transform("ls", lambda x: x["symbol"]), ",")).drop("ls")
    return out if limit is None else out.orderBy("has_news", "id").limit(limit)


def unmatched_requests(requested: DataFrame, companies: DataFrame, tier: DataFrame) -> DataFrame:
    """Requested tickers that give nothing: absent from the catalogue, or excluded by the tier."""
    up = lambda df: df.select(F.upper("ticker").alias("key")).distinct()
    asked = requested.select("ticker", F.upper("ticker").alias("key"))
    absent = asked.join(up(companies), "key", "left_anti").withColumn("reason", F.lit("not_in_catalogue"))
    excluded = asked.join(up(companies), "key", "left_semi").join(up(tier), "key", "left_anti").withColumn("reason", F.lit("excluded_by_tier"))
    return absent.unionByName(excluded).drop("key")


def newest_first_backfill(articles: DataFrame, state: DataFrame, keys: list[str], cap: int = 25) -> DataFrame:
    """On the first backfill of a key only its newest articles; all of them once there is state."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("published_at").desc(), "url"))
    known = state.filter("last_success_at IS NOT NULL").select(*keys).distinct().withColumn("__known", F.lit(True))
    return articles.withColumn("__n", place).join(known, keys, "left").filter("__known OR __n <= %d" % cap).drop("__n", "__known")
