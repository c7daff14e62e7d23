"""State transitions as functions: merge(old state, batch) -> new state.

Each also runs under Structured Streaming (see :mod:`pressline.streaming.jobs`).  Ordered folds
per key go through windows where a closed form exists, and through applyInPandas where each
step depends on the one before.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import hashing, relevance, url

FAILURES_TO_SUPPRESS, SUPPRESS_HOURS = 5, 24
WITHDRAWN = "This source article was withdrawn."
MERGED = ("name_normalized", "company_name", "sector", "country", "is_us_listed", "exchange_hint")


def catalogue_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue upsert by ticker: change is inserted, updated, unchanged or deactivated; another name or hint starts resolution again; rows missing from the file are inactive."""
    o = old.select("ticker", *(F.col(c).alias(f"o_{c}") for c in ("company_name", "exchange_hint", "resolution_status", "is_active")))
    n = new.select("ticker", "company_name", "exchange_hint", F.lit(True).alias("is_new"))
    both = o.withColumn("is_old", F.lit(True)).join(n, "ticker", "full_outer")
    fresh, known = F.col("is_new").isNotNull(), F.col("is_old").isNotNull()
    differs = ~(F.col("company_name").eqNullSafe(F.col("o_company_name")) & F.col("exchange_hint").eqNullSafe(F.col("o_exchange_hint")))
    return both.select(
        "ticker",
        F.when(fresh, F.col("company_name")).otherwise(F.col("o_company_name")).alias("company_name"),
        F.when(fresh, F.col("exchange_hint")).otherwise(F.col("o_exchange_hint")).alias("exchange_hint"),
        F.when(fresh & (~known | differs), "pending").otherwise(F.col("o_resolution_status")).alias("resolution_status"),
        fresh.alias("is_active"),
        F.when(~known, "inserted").when(~fresh, F.when(F.col("o_is_active"), "deactivated").otherwise("unchanged")).when(differs | ~F.col("o_is_active"), "updated").otherwise("unchanged").alias("change"),
    )


def listing_replace(old: DataFrame, new: DataFrame, resolved: DataFrame) -> DataFrame:
    """Listings after a resolution of the companies in resolved: found lines replace theirs; where nothing was found, only weak catalogue assertions go."""
    found = new.select("company_id").distinct().withColumn("__found", F.lit(True))
    asked = resolved.select("company_id").distinct().withColumn("__asked", F.lit(True))
    kept = old.join(asked, "company_id", "left").join(found, "company_id", "left")
    weak = (F.col("source") == "catalogue") & (F.col("confidence") <= 0.5)
    stays = F.col("__asked").isNull() | (F.col("__found").isNull() & ~F.coalesce(weak, F.lit(False)))
    return kept.filter(stays).drop("__asked", "__found").unionByName(new.join(asked, "company_id", "left_semi"))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__n", place).filter("__n = 1").drop("__n")


def store_verdicts(batch: DataFrame, articles: DataFrame, links: DataFrame, floor: float = relevance.FLOOR) -> DataFrame:
    """Rows of an ingest batch (company_id, dedupe_hash, content_hash, relevance, seq) with what becomes of them against stored articles and links.

    verdict, the first that holds in the order of seq:

    * repeat: the company's batch had the URL before, whatever became of it;
    * known: the story is stored for the company, or an earlier row of its batch was kept for it;
    * rejected: below the relevance floor (a null relevance is); so a better-sourced twin that
      comes later may still be kept;
    * kept: the rest.

    inserted: the first kept row of an article that is not stored.  linked: a kept row whose
    company has no link to the article yet.
    """
    place = F.row_number().over(Window.partitionBy("company_id", "dedupe_hash").orderBy("seq"))
    rows = batch.withColumn("repeat", place > 1)
    stored = links.join(articles.select("dedupe_hash", "content_hash"), "dedupe_hash").select("company_id", "content_hash").distinct()
    rows = rows.join(stored.withColumn("stored", F.lit(True)), ["company_id", "content_hash"], "left")
    passes = ~F.col("repeat") & F.coalesce(F.col("relevance") >= floor, F.lit(False))
    keeper = F.min(F.when(passes, F.col("seq"))).over(Window.partitionBy("company_id", "content_hash"))
    rows = rows.withColumn("keeper", keeper)
    known = F.coalesce(F.col("stored"), F.lit(False)) | F.coalesce(F.col("keeper") < F.col("seq"), F.lit(False))
    verdict = F.when(F.col("repeat"), "repeat").when(known, "known").when(F.coalesce(F.col("keeper") == F.col("seq"), F.lit(False)), "kept").otherwise("rejected")
    rows = rows.withColumn("verdict", verdict).drop("repeat", "stored", "keeper")
    kept = F.col("verdict") == "kept"
    rows = rows.join(articles.select("dedupe_hash").distinct().withColumn("old", F.lit(True)), "dedupe_hash", "left")
    first = F.min(F.when(kept, F.col("seq"))).over(Window.partitionBy("dedupe_hash")) == F.col("seq")
    rows = rows.withColumn("inserted", kept & F.col("old").isNull() & F.coalesce(first, F.lit(False)))
    rows = rows.join(links.select("dedupe_hash", "company_id").distinct().withColumn("has", F.lit(True)), ["dedupe_hash", "company_id"], "left")
    return rows.withColumn("linked", kept & F.col("has").isNull()).select(*batch.columns, "verdict", "inserted", "linked")


def store_articles(batch: DataFrame, articles: DataFrame, links: DataFrame, floor: float = relevance.FLOOR) -> dict[str, DataFrame]:
    """New articles, new links and rejected rows of an ingest batch."""
    rows = store_verdicts(batch, articles, links, floor)
    return {
        "inserted": rows.filter("inserted").select(*batch.columns),
        "linked": rows.filter("linked").select("dedupe_hash", "company_id", "relevance"),
        "rejected": rows.filter("verdict = 'rejected'").select(*batch.columns),
    }


def store_stats(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts of what became of a batch, for each value of the columns in by."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("inserted").alias("inserted"),
        F.count_if("linked").alias("linked"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"),
    )


def store_market(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Market stories: only new ones are inserted as market-wide, the flag of a stored row never changes."""
    fresh = first_by(batch, ["dedupe_hash"], "seq").join(articles.select("dedupe_hash"), "dedupe_hash", "left_anti").withColumn("is_market_wide", F.lit(True))
    return articles.unionByName(fresh.select(*[c for c in articles.columns if c in fresh.columns]), allowMissingColumns=True)


MARKET_CONFIDENCE, MARKET_RELEVANCE = "0.70", "0.60"
MARKET_REASON = "market-wide story naming this company"


def market_links(batch: DataFrame, symbols: DataFrame, companies: DataFrame, links: DataFrame) -> DataFrame:
    """New links (dedupe_hash, company_id, match_method, confidence, relevance, relevance_reason) of market stories (dedupe_hash, headline, related).

    A story is linked to the owners of the symbols that its source attached (symbols: symbol,
    company_id, one owner each) and to companies that its headline names exactly, whether the
    story is new or stored; a link that is there already stays as it is.
    """
    from pressline.operators import resolution

    tagged = batch.select("dedupe_hash", F.explode("related").alias("symbol")).join(symbols.select("symbol", "company_id"), "symbol").select("dedupe_hash", "company_id")
    named = resolution.story_mentions(batch.select(F.col("dedupe_hash").alias("story_id"), F.col("headline").alias("text")).distinct(), companies)
    both = tagged.unionByName(named.select(F.col("story_id").alias("dedupe_hash"), "company_id")).distinct()
    fresh = both.join(links.select("dedupe_hash", "company_id"), ["dedupe_hash", "company_id"], "left_anti")
    value = lambda v: F.lit(v).cast("decimal(3,2)")
    return fresh.withColumns({"match_method": F.lit("name_match"), "confidence": value(MARKET_CONFIDENCE), "relevance": value(MARKET_RELEVANCE), "relevance_reason": F.lit(MARKET_REASON)})


def fetch_state(outcomes: DataFrame, keys=("company_id", "provider")) -> DataFrame:
    """State after outcomes in order of seq (seq, at, ok, newest): failures since the last success, last success, newest article, suppression.

    Gaps and islands: successes number the islands, so no step by step fold is needed.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("seq")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = outcomes.withColumn("island", F.coalesce(island, F.lit(0)))
    last = F.max("island").over(Window.partitionBy(*keys))
    out = rows.withColumn("last", last).groupBy(*keys).agg(
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
        F.max(F.when(F.col("ok"), F.col("newest"))).alias("last_article_at"),
        F.count_if((F.col("island") == F.col("last")) & ~F.col("ok")).alias("consecutive_failures"),
        F.max(F.when((F.col("island") == F.col("last")) & ~F.col("ok"), F.col("at"))).alias("last_failure_at"),
    )
    until = F.when(F.col("consecutive_failures") >= FAILURES_TO_SUPPRESS, F.col("last_failure_at") + F.expr(f"INTERVAL {SUPPRESS_HOURS} HOURS"))
    return out.withColumn("suppressed_until", until).drop("last_failure_at")


def not_suppressed(df: DataFrame, state: DataFrame, as_of, override: bool = False) -> DataFrame:
    """Rows whose (company, provider) is not backed off."""
    if override:
        return df
    off = state.filter(F.col("suppressed_until") > F.lit(as_of)).select("company_id", "provider")
    return df.join(off, ["company_id", "provider"], "left_anti")


def fetch_from(last_success: Column, as_of: Column, lookback_days: int | None = None) -> Column:
    """Start of the fetch window: an explicit look-back; else 6 hours before the last success but not before 30 days ago; else 90 days."""
    if lookback_days is not None:
        return as_of - F.make_interval(days=F.lit(lookback_days))
    return F.when(last_success.isNull(), as_of - F.expr("INTERVAL 90 DAYS")).otherwise(F.greatest(last_success - F.expr("INTERVAL 6 HOURS"), as_of - F.expr("INTERVAL 30 DAYS")))


def cascade_outcome(attempts: Column, authoritative: Column) -> Column:
    """Outcome of ordered attempts (provider, outcome): the first ok; else the first failure; else no_news once any answered; else skipped.

    authoritative: names of providers whose empty answer ends the chain (unless an attempt
    follows, which then was made because a ticker-native provider stood after it).
    """
    ok = F.exists(attempts, lambda a: a["outcome"] == "ok")
    failed = F.filter(attempts, lambda a: ~a["outcome"].isin("ok", "no_news", "skipped"))
    ends = F.exists(attempts, lambda a: (a["outcome"] == "no_news") & F.array_contains(authoritative, a["provider"]))
    first_failure = F.get(failed, 0)
    answered = F.exists(attempts, lambda a: a["outcome"] == "no_news")
    place = lambda o: F.array_position(F.transform(attempts, lambda a: a["outcome"]), o)
    failed_first = first_failure.isNotNull() & (~ends | (place(first_failure["outcome"]) < place(F.lit("no_news"))))
    return F.when(ok, "ok").when(failed_first, first_failure["outcome"]).when(answered, "no_news").when(first_failure.isNotNull(), first_failure["outcome"]).otherwise("skipped")


#: Fields of a source event beside its identity and action; those that a source lacks are null.
FIELDS = {"headline": "string", "summary": "string", "body": "string", "url": "string", "publisher": "string", "image_url": "string", "published_at": "timestamp", "updated_at": "timestamp", "topics": "array<string>", "companies": "string", "body_allowed": "boolean", "image_allowed": "boolean"}
EVENT = "provider_id string, source_id string, seq bigint, action string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", content_hash string, deleted boolean"
REVISION = EVENT + ", revision int"
KEY = ("provider_id", "source_id")


def events_of(events: DataFrame) -> DataFrame:
    """Source events as they are stored, with content_hash and deleted.

    A withdrawal keeps its identity, topics and time; headline, texts, image and rights are those of a tombstone.
    """
    gone = F.col("action") == "delete"
    given = {f: F.col(f).cast(kind) if f in events.columns else F.lit(None).cast(kind) for f, kind in FIELDS.items()}
    tomb = {"headline": F.lit(WITHDRAWN), **{f: F.lit(None).cast(FIELDS[f]) for f in ("summary", "body", "image_url", "companies")}, "body_allowed": F.lit(False), "image_allowed": F.lit(False)}
    fields = {f: F.when(gone, tomb[f]).otherwise(c) if f in tomb else c for f, c in given.items()}
    rows = events.select(*KEY, F.col("seq").cast("long").alias("seq"), "action", *(c.alias(f) for f, c in fields.items()))
    # url and date of a withdrawal are the article's, whatever it says
    hashed = [F.when(F.col("action") != "delete", F.col(f)).alias(f) if f in ("url", "published_at") else F.col(f) for f in FIELDS]
    return rows.withColumns({"content_hash": hashing.revision_hash(F.col("action"), *hashed), "deleted": F.col("action") == "delete"})


class Last:
    """What the next event of an article is held against."""

    def __init__(self, digest=None, updated=None, deleted=False, revision=0):
        self.digest, self.updated, self.deleted, self.revision = digest, updated, deleted, revision

    def takes(self, digest, updated, deleted: bool, strict: bool) -> bool:
        """Is an event kept?  Equal content and stale times are not; with strict, nor is what would bring a withdrawn article back without a later time."""
        updated = None if pd.isna(updated) else updated
        if self.revision:
            if digest == self.digest or (self.updated is not None and updated is not None and updated < self.updated):
                return False
            if strict and self.deleted and not deleted and (updated is None or self.updated is None or updated <= self.updated):
                return False
        self.digest, self.updated, self.deleted, self.revision = digest, updated, deleted, self.revision + 1
        return True


def _accepted(strict: bool):
    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, kept = rows.sort_values(["seq", "content_hash"]), Last(), []
        for r in rows.itertuples(index=False):
            if last.takes(r.content_hash, r.updated_at, r.deleted, strict):
                kept.append((key[0], key[1], r.seq, r.content_hash, last.revision))
        return pd.DataFrame(kept, columns=["provider_id", "source_id", "seq", "content_hash", "revision"])

    return fold


def scrubbed(history: DataFrame) -> DataFrame:
    """Revisions as readers may see them: a withdrawal takes texts, images and rights of all before it, and has the url and date of the article."""
    every = Window.partitionBy(*KEY)
    tomb = F.max(F.when(F.col("deleted"), F.col("revision"))).over(every)
    hidden = F.coalesce(F.col("revision") <= tomb, F.lit(False))
    before = every.orderBy("revision").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {f: F.last(F.when(~F.col("deleted"), F.col(f)), ignorenulls=True).over(before) for f in ("url", "published_at")}
    out = history.withColumns({"__hidden": hidden, "stored": F.count(F.lit(1)).over(every).cast("int"), **{f: F.when(F.col("deleted"), F.coalesce(c, F.col(f))).otherwise(F.col(f)) for f, c in carried.items()}})
    texts = {f: F.when(~F.col("__hidden"), F.col(f)) for f in ("summary", "body", "image_url")}
    return out.withColumns(texts | {"body_allowed": F.col("body_allowed") & ~F.col("__hidden")}).drop("__hidden")


def revisions(events: DataFrame, strict_tombstones: bool = False) -> DataFrame:
    """Revision history of source articles from events (provider_id, source_id, action, seq and any of FIELDS).

    Equal content and stale updates are skipped, a delete rewrites the article as a tombstone
    and scrubs what was kept so far.  A stale update without a time can bring a withdrawn
    article back, as documented; strict_tombstones keeps it withdrawn.  Each step depends on the
    kept one before it, so this is a fold per article, over hashes and times alone; texts stay
    in the engine.
    """
    rows = events_of(events).dropDuplicates([*KEY, "seq", "content_hash"])
    thin = rows.select(*KEY, "seq", "content_hash", "updated_at", "deleted")
    kept = thin.groupBy(*KEY).applyInPandas(_accepted(strict_tombstones), "provider_id string, source_id string, seq bigint, content_hash string, revision int")
    return scrubbed(rows.join(kept, [*KEY, "seq", "content_hash"]))


def revision_links(history: DataFrame, matches: DataFrame) -> DataFrame:
    """Companies of the current articles, rebuilt at each revision: article's hints (companies: a JSON array of external names) that matches (hint, company_id) knows; none of a withdrawn one."""
    now = current(history).filter("NOT deleted")
    hints = now.select(*KEY, F.explode(F.from_json(F.coalesce("companies", F.lit("[]")), "array<string>")).alias("hint"))
    return hints.join(matches, "hint").select(*KEY, "company_id").distinct()


def current(history: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("provider_id", "source_id").orderBy(F.col("revision").desc()))
    return history.withColumn("__n", place).filter("__n = 1").drop("__n")


def purge_bodies(rows: DataFrame, providers: list[str]) -> DataFrame:
    """Current rows or history after providers lost the right to show bodies."""
    lost = F.col("provider_id").isin(*providers) & F.col("body").isNotNull()
    now = {"body": F.when(~lost, F.col("body"))}
    if "body_allowed" in rows.columns:
        now["body_allowed"] = F.col("body_allowed") & ~lost
    if "content_hash" in rows.columns:  # so that the same text is taken as news once it may be shown again
        now["content_hash"] = F.when(lost, F.concat(F.lit("purged:"), F.col("content_hash"))).otherwise(F.col("content_hash"))
    return rows.withColumns(now)


def purge_provider(rows: DataFrame, providers: list[str]) -> DataFrame:
    """Rows after providers' credentials or licences changed."""
    return rows.filter(~F.col("provider_id").isin(*providers))


def import_snapshot(companies: DataFrame, listings: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows that may be imported: pending companies without listings, whose identity is the snapshot's (nulls equal)."""
    open_ = companies.filter("resolution_status = 'pending'").join(listings.select(F.col("company_id").alias("id")), "id", "left_anti")
    s = snapshot.select("ticker", F.col("company_name").alias("s_name"), F.col("country").alias("s_country"), F.col("exchange_hint").alias("s_hint"), *(c for c in snapshot.columns if c not in ("ticker", "company_name", "country", "exchange_hint", "resolution_status")), F.col("resolution_status").alias("s_status"))
    same = (open_["ticker"] == s["ticker"]) & open_["company_name"].eqNullSafe(s["s_name"]) & open_["country"].eqNullSafe(s["s_country"]) & open_["exchange_hint"].eqNullSafe(s["s_hint"])
    return open_.select("id", "ticker", "company_name", "country", "exchange_hint").join(s, same).drop(s["ticker"]).drop("s_name", "s_country", "s_hint")


def seed_aliases(candidates: DataFrame, companies: DataFrame, listings: DataFrame, stored: DataFrame) -> DataFrame:
    """Reviewed aliases that can be stored: exactly one active issuer, its listing where one is needed, no other issuer on the venue's symbol, not stored yet."""
    issuer = companies.filter("is_active").groupBy(F.upper("ticker").alias("ticker"), F.upper("country").alias("country")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("company_id")).filter("n = 1").drop("n")
    hit = candidates.join(issuer, ["ticker", "country"])
    line = listings.select("company_id", F.upper("symbol").alias("ticker"), F.upper("mic").alias("mic")).distinct()
    ok = hit.filter("NOT requires_listing").unionByName(hit.filter("requires_listing").join(line, ["company_id", "ticker", "mic"], "left_semi"))
    other = line.select(F.col("company_id").alias("oid"), "ticker", "mic")
    clash = ok.join(other, ["ticker", "mic"]).filter("oid <> company_id").select("alias_key", "ticker", "mic", "country").distinct()
    key = ["alias_key", "ticker", "mic", "country"]
    return ok.join(clash, key, "left_anti").join(stored.select(*key), key, "left_anti")


def merge_plan(articles: DataFrame, resolved: DataFrame) -> DataFrame:
    """What becomes of the articles whose wrapper links were resolved (id, new_url): id, action, survivor, url, dedupe_hash.

    Only resolved articles change.  One that leads to a dead host goes (``dead``).  Of the
    others that share a destination, the article that has it already, whatever its id, else the
    resolved one with the smallest id, survives: a resolved survivor is ``rewritten``, the rest
    are ``merged`` into it.  Stored articles have a dedupe_hash column; where it is missing it
    is made from the url.
    """
    if "dedupe_hash" not in articles.columns:
        articles = articles.withColumn("dedupe_hash", hashing.dedupe_hash(url.canonical_url(F.col("url"))))
    new = resolved.filter("new_url IS NOT NULL").select("id", "new_url")
    touched = articles.select("id").join(new, "id").withColumn("key", hashing.dedupe_hash(url.canonical_url(F.col("new_url")))).withColumn("dead", url.is_dead_host(F.col("new_url")))
    first = touched.filter("NOT dead").groupBy("key").agg(F.min("id").alias("first"))
    owners = articles.select("id", F.col("dedupe_hash").alias("key")).join(first.select("key"), "key", "left_semi").join(new.select("id"), "id", "left_anti")
    owners = owners.groupBy("key").agg(F.min("id").alias("owner"))
    plan = touched.join(first, "key", "left").join(owners, "key", "left").withColumn("survivor", F.when(~F.col("dead"), F.coalesce("owner", "first")))
    action = F.when(F.col("dead"), "dead").when(F.col("survivor") == F.col("id"), "rewritten").otherwise("merged")
    return plan.select("id", action.alias("action"), "survivor", F.col("new_url").alias("url"), F.col("key").alias("dedupe_hash"))


def merge_colliding(articles: DataFrame, links: DataFrame, resolved: DataFrame, stage=None) -> dict[str, DataFrame]:
    """The articles, their links and the deleted ids once wrapper links are resolved, by merge_plan.

    A survivor gets the companies that it lacks of the articles merged into it; where several
    bring one company, the link of the survivor itself counts, else of the smallest id.

    All three results follow from the plan, a thin row for each resolved article: stage, a
    function that writes a frame and reads it back, has it made once.
    """
    plan = merge_plan(articles, resolved)
    plan = stage(plan) if stage else plan
    told = plan.select("id", "action", "survivor", F.col("url").alias("__url"), F.col("dedupe_hash").alias("__hash"))
    now = articles.join(told, "id", "left").withColumn("action", F.coalesce("action", F.lit("untouched")))
    moved = F.col("action") == "rewritten"
    new = {"url": F.when(moved, F.col("__url")).otherwise(F.col("url"))}
    if "dedupe_hash" in articles.columns:
        new["dedupe_hash"] = F.when(moved, F.col("__hash")).otherwise(F.col("dedupe_hash"))
    kept = now.filter("action IN ('untouched', 'rewritten')").withColumns(new).select(*articles.columns)
    to = links.join(plan.select(F.col("id").alias("article_id"), "action", "survivor"), "article_id", "left").filter("action IS NULL OR action <> 'dead'")
    to = to.withColumn("target", F.coalesce("survivor", "article_id"))
    place = F.row_number().over(Window.partitionBy("target", "company_id").orderBy(F.col("article_id") != F.col("target"), "article_id"))
    to = to.withColumn("__n", place).filter("__n = 1").withColumn("article_id", F.col("target")).select(*links.columns)
    return {"articles": kept, "links": to, "deleted": now.filter("action IN ('merged', 'dead')").select("id", "action")}


def known_urls(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Wrapper URLs replaced by what an earlier run resolved for the same story."""
    seen = articles.groupBy("content_hash").agg(F.max_by("url", "id").alias("known"))
    return batch.join(seen, "content_hash", "left").withColumn("url", F.when(url.is_wrapper(F.col("url")), F.coalesce("known", "url")).otherwise(F.col("url"))).drop("known")


def fingerprint_diff(entries: DataFrame, seen: DataFrame, scans: DataFrame, as_of, full_scan_hours: int = 24, retries: int = 3) -> DataFrame:
    """The entries of one poll (feed, entry_id, fingerprint) with why: new, changed, retry, image or due; null for those that are left alone.

    seen (feed, entry_id, seen_fingerprint, imported, failures, blocked, image_checked) is what
    became of entries that were fetched; a denied one is never fetched again, a failed one three
    more times.  scans (feed, scanned_at) tells of each feed's last full scan: after a day, or
    without one, all its entries are due.  Entries that left the feed are in no result.
    """
    both = entries.join(seen, ["feed", "entry_id"], "left").join(scans, "feed", "left")
    c = F.col
    due = c("scanned_at").isNull() | (c("scanned_at") <= F.lit(as_of) - F.make_interval(hours=F.lit(full_scan_hours)))
    why = (
        F.when(F.coalesce("blocked", F.lit(False)), F.lit(None))
        .when(c("seen_fingerprint").isNull(), "new")
        .when(c("seen_fingerprint") != c("fingerprint"), "changed")
        .when(c("failures").between(1, retries), "retry")
        .when(c("imported") & ~c("image_checked") & (c("failures") == 0), "image")
        .when(due, "due")
    )
    return both.withColumn("why", why)


def advance_watermark(old: Column, newest: Column, complete: Column) -> Column:
    """The watermark moves, forward only, after complete windows."""
    return F.when(complete, F.greatest(old, newest)).otherwise(old)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
