"""The record formats of three licensed sources, as the common articles of ``files.provider_articles``.

Rows come as frames of the schemas below, a row a record.  A record without a usable identity,
public link, headline or time makes the batch invalid, as its window is then read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import text, url
from pressline.sources.files import InvalidSource

MARKETAUX = "uuid string, url string, title string, description string, snippet string, source string, language string, published_at string, entities array<struct<symbol:string,name:string,exchange:string,country:string>>"
BENZINGA = "id string, url string, title string, teaser string, body string, created string, updated string, correction boolean, channels array<struct<name:string>>, stocks array<struct<name:string,exchange:string,isin:string>>"
FINNHUB = "id string, url string, headline string, summary string, source string, datetime bigint"
COMPANY = "struct<ticker:string,exchange:string,country:string,name:string,external_id:string>"
# Topics by what a headline says, and the one of all others.
TOPICS = (
    ("earnings", r"(?i)earnings|revenue|quarterly results"),
    ("inflation", r"(?i)inflation|consumer prices|\bCPI\b"),
    ("monetary-policy", r"(?i)federal reserve|central bank|interest rates|monetary"),
    ("regulation", r"(?i)regulat|enforcement|securities commission"),
)
OTHER_TOPIC = "markets"
MAX_BODY = 160_000


def topics(said: Column) -> Column:
    found = F.filter(F.array(*(F.when(said.rlike(pattern), name) for name, pattern in TOPICS)), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_TOPIC)))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _company(**fields) -> Column:
    return F.struct(*(fields.get(f, F.lit(None).cast("string")).alias(f) for f in ("ticker", "exchange", "country", "name", "external_id")))


def _articles(rows: DataFrame, provider: str, source_id: Column, title: Column, published: Column, **fields) -> DataFrame:
    """rows with what every article needs, checked, and the given fields."""
    base = {"source_id": _filled(source_id), "url": url.safe_public_url(F.col("url")), "headline": _filled(text.plain_text(title)), "published_at": published}
    out = rows.select(F.lit(provider).alias("provider_id"), F.lit("upsert").alias("action"), *(c.alias(k) for k, c in (base | fields).items()))
    if not out.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in base))).isEmpty():
        raise InvalidSource(f"an article of {provider} lacks a usable identity, link, headline or time")
    return out


def marketaux(rows: DataFrame) -> DataFrame:
    """Summaries of many publishers with the companies that they name."""
    named = F.filter(F.coalesce("entities", F.array().cast("array<struct<symbol:string,name:string,exchange:string,country:string>>")), lambda e: (F.coalesce(e["symbol"], F.lit("")) != "") | (F.coalesce(e["name"], F.lit("")) != ""))
    part = lambda c: F.coalesce(c, F.lit(""))
    hint = lambda e: _company(ticker=_filled(e["symbol"]), exchange=_filled(e["exchange"]), country=_filled(F.upper(e["country"])), name=_filled(e["name"]), external_id=F.concat(F.lit("marketaux:"), part(e["symbol"]), F.lit(":"), part(e["exchange"]), F.lit(":"), part(e["country"])))
    summary = _filled(text.plain_text(F.coalesce(_filled(F.col("description")), _filled(F.col("snippet")), F.lit(""))))
    publisher = F.coalesce(_filled(F.col("source")), url.host(F.col("url")))
    title = text.plain_text(F.coalesce("title", F.lit("")))
    return _articles(rows, "marketaux", F.col("uuid"), F.coalesce("title", F.lit("")), F.try_to_timestamp("published_at"), summary=summary, publisher=publisher, language=_filled(F.col("language")), topics=topics(title), genre=F.lit("news-summary"), companies=F.transform(named, hint))


def benzinga(rows: DataFrame, window_end, full_text: bool = False) -> DataFrame:
    """Licensed news up to the end of the window; later updates belong to the next one.  Bodies are there only with full text; a correction is what the source calls one."""
    updated = F.try_to_timestamp("updated")
    if not rows.filter(updated.isNull()).isEmpty():
        raise InvalidSource("an article of benzinga lacks the time of its update")
    rows = rows.filter(updated <= F.lit(window_end))
    body = _filled(text.plain_text(F.coalesce("body", F.lit("")))) if full_text else F.lit(None).cast("string")
    if full_text and not rows.filter(F.length(body) > MAX_BODY).isEmpty():
        raise InvalidSource("a body of benzinga is beyond what readers get")
    title = text.plain_text(F.coalesce("title", F.lit("")))
    channels = F.array_join(F.transform(F.coalesce("channels", F.array().cast("array<struct<name:string>>")), lambda c: F.coalesce(c["name"], F.lit(""))), " ")
    stocks = F.coalesce("stocks", F.array().cast("array<struct<name:string,exchange:string,isin:string>>"))
    hint = lambda s: _company(ticker=_filled(s["name"]), exchange=_filled(s["exchange"]), external_id=F.concat(F.lit("isin:"), _filled(s["isin"])))
    return _articles(
        rows, "benzinga", F.col("id"), F.coalesce("title", F.lit("")), F.try_to_timestamp("created"),
        summary=_filled(text.plain_text(F.coalesce("teaser", F.lit("")))), body=body, body_allowed=body.isNotNull(), publisher=F.lit("Benzinga"), updated_at=updated, language=F.lit("en"),
        topics=topics(F.concat(title, F.lit(" "), channels)), genre=F.lit("licensed-news"), companies=F.transform(stocks, hint), correction=F.coalesce("correction", F.lit(False)),
    )


def benzinga_removed(rows: DataFrame) -> DataFrame:
    """Ids of withdrawn articles as deletes; what else is known of them is the store's."""
    if not rows.filter(F.coalesce("id", F.lit("")) == "").isEmpty():
        raise InvalidSource("a removal of benzinga lacks its article's id")
    return rows.select(F.lit("benzinga").alias("provider_id"), F.lit("delete").alias("action"), F.col("id").alias("source_id"), F.lit("Benzinga").alias("publisher"), F.lit(False).alias("body_allowed"))


def finnhub(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    """Summaries of the general feed, or of one symbol that was asked for and which they then are about."""
    hints = F.array(_company(ticker=F.lit(symbol), external_id=F.lit(f"finnhub-query:{symbol}"))) if symbol else F.array().cast(f"array<{COMPANY}>")
    title = text.plain_text(F.coalesce("headline", F.lit("")))
    return _articles(rows, "finnhub", F.col("id"), F.coalesce("headline", F.lit("")), F.timestamp_seconds("datetime"), summary=_filled(text.plain_text(F.coalesce("summary", F.lit("")))), publisher=F.coalesce(_filled(F.col("source")), url.host(F.col("url"))), language=F.lit("en"), topics=topics(title), genre=F.lit("news-summary"), companies=hints)
