"""Revisioned articles: entitlement, readability, scopes, keyset pages and display projection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import names, text, url
from pressline.functions.exchange import exchange_key

MACRO_PROVIDERS, MACRO_TOPICS = ("fed", "ecb"), ("monetary-policy", "inflation")


def provider_status(definitions: DataFrame, config: DataFrame, state: DataFrame, articles: DataFrame, as_of: date) -> DataFrame:
    """Definitions with their configuration, today's request count and number of live articles."""
    n = articles.filter("NOT deleted").groupBy("provider_id").agg(F.count(F.lit(1)).alias("articles"))
    out = definitions.join(config, "provider_id", "left").join(state, "provider_id", "left").join(n, "provider_id", "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("enabled", "configured", "display_licensed", "full_text_enabled")}
    return out.withColumns(flags | {"requests_today": spent_today(F.col("requests_today"), F.col("budget_day"), as_of), "articles": F.coalesce("articles", F.lit(0))})


def spent_today(requests: Column, day: Column, as_of: date) -> Column:
    """Requests of today; a count of another day is over."""
    return F.when(day == F.lit(as_of), F.coalesce(requests, F.lit(0))).otherwise(0)


def is_due(as_of) -> Column:
    """May a source be scheduled now?"""
    c = F.col
    waited = c("last_success_at").isNull() | (c("last_success_at") + F.make_interval(mins=c("refresh_minutes")) <= F.lit(as_of))
    auth = F.coalesce(c("last_error").startswith("[auth]"), F.lit(False))
    return F.coalesce(c("enabled") & c("configured") & c("display_licensed") & (c("requests_today") < c("budget")) & ~auth & waited, F.lit(False))


def entitled(articles: DataFrame, status: DataFrame, source: str = "all") -> DataFrame:
    """Articles of providers that are on, configured, licensed and inside the source filter (free, all or an id)."""
    on = status.filter("enabled AND configured AND display_licensed")
    if source == "free":
        on = on.filter("free")
    elif source != "all":
        on = on.filter(F.col("provider_id") == source)
    return articles.join(on.select("provider_id", "free", "full_text_enabled"), "provider_id")


def squashed(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def is_readable() -> Column:
    """A body that may be shown, or a summary of 80 characters with at least 40 beyond the headline."""
    body = (F.col("free") | F.col("full_text_enabled")) & F.col("rights.bodyAllowed") & (F.length(F.trim(F.coalesce("body", F.lit("")))) > 0)
    head, rest = squashed(F.col("headline")), squashed(F.col("summary"))
    beyond = F.when(head == "", rest).otherwise(F.replace(rest, head, F.lit("")))
    summary = (F.length(F.trim(F.coalesce("summary", F.lit("")))) >= 80) & (F.length(beyond) >= 40)
    return F.coalesce(body, F.lit(False)) | summary


def in_scope(articles: DataFrame, scope: str, links: DataFrame | None = None, company_ids: list | None = None) -> DataFrame:
    """all; company or portfolio (an empty list gives nothing); macro."""
    if scope in ("company", "portfolio"):
        if not company_ids:
            return articles.limit(0)
        return articles.join(links.filter(F.col("company_id").isin(*company_ids)).select(F.col("article_id").alias("id")), "id", "left_semi")
    if scope == "macro":
        topical = F.arrays_overlap("topics", F.array(*(F.lit(t) for t in MACRO_TOPICS)))
        return articles.filter(F.coalesce(F.col("provider_id").isin(*MACRO_PROVIDERS) | (F.col("genre") == "macro"), F.lit(False)) | F.coalesce(topical, F.lit(False)))
    return articles


def has_topic(topic: str) -> Column:
    return F.array_contains("topics", topic)


def mentions(q: str) -> Column:
    """Case-insensitive pattern in headline or summary; % and _ in q keep their meaning."""
    return F.col("headline").ilike(f"%{q}%") | F.coalesce(F.col("summary").ilike(f"%{q}%"), F.lit(False))


def before(cursor: tuple | None, ts: str = "published_at", key: str = "id") -> Column:
    if cursor is None:
        return F.lit(True)
    when, at = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
    return (F.col(ts) < when) | ((F.col(ts) == when) & (F.col(key) < at))


def keyset_page(df: DataFrame, limit: int, cursor: tuple | None = None, ts: str = "published_at", key: str = "id") -> DataFrame:
    """limit + 1 rows after the cursor, newest first: the last one only shows that there are more."""
    return df.filter(before(cursor, ts, key)).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit + 1)


def directory_page(companies: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    out = companies.filter("is_active")
    return (out if after is None else out.filter(F.col("id") > after)).orderBy("id").limit(limit + 1)


def displayed(article: DataFrame) -> DataFrame:
    """What a reader may see of entitled articles (columns free and full_text_enabled from ``entitled``); the body's place in a feed is its preview."""
    may = F.coalesce(F.col("rights.bodyAllowed") & (F.col("free") | F.col("full_text_enabled")), F.lit(False))
    body = F.when(may, F.col("body"))
    return article.select(
        "id",
        F.when(F.col("deleted"), "This source article was withdrawn.").otherwise(F.col("headline")).alias("headline"),
        F.when(~F.col("deleted"), F.col("summary")).alias("summary"),
        text.preview_text(F.when(~F.col("deleted"), F.coalesce(body, F.col("summary")))).alias("preview_text"),
        text.reading_minutes(F.when(~F.col("deleted"), body)).alias("reading_minutes"),
        F.when(F.col("deleted"), "link_only").when(body.isNotNull() & (body != ""), "full_text").when(F.col("summary").isNotNull(), "summary").otherwise("link_only").alias("content_mode"),
        F.when(F.col("free"), "official").when(F.col("provider_id") == "benzinga", "wire").otherwise("aggregator").alias("source_kind"),
        F.when(F.coalesce(F.col("rights.imageAllowed"), F.lit(False)) & ~F.col("deleted"), url.safe_public_url(F.col("image_url"))).alias("image_url"),
        "published_at",
        "revision",
    )


def coverage_summary(articles: DataFrame, links: DataFrame) -> DataFrame:
    live = articles.filter("NOT deleted")
    return live.agg(F.count(F.lit(1)).alias("articles"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"), F.countDistinct("provider_id").alias("providers")).crossJoin(links.agg(F.countDistinct("company_id").alias("companies")))


def resume_checkpoint(jobs: DataFrame, providers: DataFrame) -> DataFrame:
    """Checkpoint to resume from: the latest job's if it ended partial or failed, else the provider's."""
    last = jobs.groupBy("provider_id").agg(F.max_by(F.struct("status", "checkpoint"), F.struct("created_at", "id")).alias("last"))
    kept = F.when(F.col("last.status").isin("partial", "failed"), F.col("last.checkpoint"))
    return providers.join(last, "provider_id", "left").select("provider_id", F.coalesce(kept, F.col("checkpoint")).alias("checkpoint"))


# ---------------------------------------------------------------- identity


def resolve_hints(hints: DataFrame, companies: DataFrame, listings: DataFrame, candidates: int = 6) -> DataFrame:
    """matched, ambiguous or unmatched for hints (hint_id, ticker, name, country, exchange).

    Candidates agree with every given part (an exchange with the symbol on it); of the first
    ``candidates`` by id those with the right name count; a ticker alone proves nothing.
    """
    c = F.col
    h = hints.select("hint_id", F.upper(F.trim(F.coalesce("ticker", F.lit("")))).alias("ht"), F.trim(F.coalesce("name", F.lit(""))).alias("hn"), F.upper(F.trim(F.coalesce("country", F.lit("")))).alias("hc"), exchange_key(c("exchange")).alias("he"))
    h = h.withColumn("strict", (c("ht") != "") & (c("hn") != "") & (c("hc") != "") & (c("he") != ""))
    who = companies.filter("is_active").select(c("id").alias("cid"), F.upper("ticker").alias("ct"), "company_name", F.upper("country").alias("cc"))
    on = listings.select(c("company_id").alias("cid"), F.upper("symbol").alias("sym"), F.upper("mic").alias("mic"), F.upper("exchange_code").alias("ex"))
    by_ticker = h.filter("ht <> ''").join(who, c("ht") == c("ct"))
    by_symbol = h.filter("ht <> ''").join(on.select("cid", "sym").distinct(), c("ht") == c("sym")).drop("sym").join(who, "cid")
    by_name = h.filter("ht = ''").join(who, F.lower("hn") == F.lower("company_name"))
    cols = [*h.columns, "cid", "ct", "company_name", "cc"]
    found = by_ticker.select(*cols).union(by_symbol.select(*cols)).union(by_name.select(*cols)).distinct()
    found = found.filter(((c("hn") == "") | (F.lower("company_name") == F.lower("hn")) | c("strict")) & ((c("hc") == "") | (c("cc") == c("hc"))))
    venue = on.select("cid", "sym", F.explode(F.array("mic", "ex")).alias("v")).filter("v IS NOT NULL").distinct()
    anywhere = venue.select("cid", c("v").alias("he")).distinct()
    placed = found.filter("he <> '' AND ht <> ''").join(venue.select("cid", c("sym").alias("ht"), c("v").alias("he")), ["cid", "ht", "he"], "left_semi")
    loose = found.filter("he <> '' AND ht = ''").join(anywhere, ["cid", "he"], "left_semi")
    found = found.filter("he = ''").unionByName(placed).unionByName(loose)
    from pyspark.sql import Window

    found = found.withColumn("place", F.row_number().over(Window.partitionBy("hint_id").orderBy("cid"))).filter(c("place") <= candidates)
    right = (c("hn") == "") | (F.lower("company_name") == F.lower("hn")) | (c("strict") & (names.issuer_key(c("company_name")) == names.issuer_key(c("hn"))))
    counted = found.filter(right).groupBy("hint_id").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid"))
    grounded = (c("hn") != "") | (c("he") != "") | ((c("hc") != "") & (c("ht") != ""))
    out = h.join(counted, "hint_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    matched = (c("n") == 1) & grounded
    return out.select("hint_id", F.when(matched, "matched").when(c("n") > 0, "ambiguous").otherwise("unmatched").alias("status"), F.when(matched, c("cid")).alias("company_id"), c("n").alias("candidates"))


def usable_aliases(aliases: DataFrame, today: date) -> DataFrame:
    """Enabled aliases inside their interval: checked by today and valid beyond it."""
    return aliases.filter(F.col("enabled") & (F.col("checked_at") <= F.lit(today)) & (F.col("valid_until") > F.lit(today)))


def alias_matches(hints: DataFrame, aliases: DataFrame, companies: DataFrame, listings: DataFrame, today: date) -> DataFrame:
    """Hints (hint_id, ticker, exchange, country, name, all needed) that an audited alias resolves: matched, or ambiguous where another issuer trades under the same symbol and venue."""
    c = F.col
    h = hints.select("hint_id", F.upper("ticker").alias("ticker"), exchange_key(c("exchange")).alias("mic"), F.upper("country").alias("country"), names.issuer_key(c("name")).alias("alias_key"))
    a = usable_aliases(aliases, today).select("company_id", names.issuer_key(c("alias_name")).alias("alias_key"), names.issuer_key(c("issuer_name")).alias("issuer"), F.upper("ticker").alias("ticker"), F.upper("mic").alias("mic"), F.upper("country").alias("country"), "requires_listing")
    who = companies.filter("is_active").select(c("id").alias("company_id"), F.upper("ticker").alias("ticker"), F.upper("country").alias("country"), names.issuer_key(c("company_name")).alias("issuer"))
    hit = h.join(a, ["alias_key", "ticker", "mic", "country"]).join(who, ["company_id", "ticker", "country", "issuer"])
    line = listings.select("company_id", F.upper("symbol").alias("ticker"), exchange_key(F.coalesce("mic", "exchange_code")).alias("mic")).distinct()
    listed = hit.join(line, ["company_id", "ticker", "mic"], "left_semi")
    hit = hit.filter("NOT requires_listing").unionByName(listed.filter("requires_listing"))
    others = line.join(who.select("company_id", c("issuer").alias("other")), "company_id").select(c("company_id").alias("oid"), "ticker", "mic", "other")
    clash = hit.join(others, ["ticker", "mic"]).filter((c("oid") != c("company_id")) & (c("other") != c("issuer"))).select("hint_id").distinct().withColumn("clash", F.lit(True))
    return hit.join(clash, "hint_id", "left").select("hint_id", F.when(c("clash"), "ambiguous").otherwise("matched").alias("status"), F.when(c("clash").isNull(), c("company_id")).alias("company_id"))
