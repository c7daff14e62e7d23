"""Operational analytics: runs, connectivity, segments, gaps, evaluation, quotes and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.schemas import ATTEMPT

GONE_OTC = "OOTC"
# Labels.
DEFINITIVE = ("ok", "no_news", "skipped")
ANSWERS = ("ok", "no_news")
FAULTS = ("not_connected_unresolved", "no_definitive_answer", "no_provider_covers_this_market")


def attempts(json_text: Column) -> Column:
    return F.from_json(json_text, f"array<{ATTEMPT}>")


# ---------------------------------------------------------------- runs


def provider_breakdown(rows: DataFrame) -> DataFrame:
    """Companies and new articles per provider and outcome."""
    return rows.groupBy("provider", "outcome").agg(F.count(F.lit(1)).alias("companies"), F.sum("articles_new").cast("long").alias("articles"))


def fallthroughs(rows: DataFrame) -> DataFrame:
    """How often an attempt of one provider failed before another one served the company."""
    each = rows.select(F.col("provider").alias("served_by"), F.inline("provider_attempts"))
    failed = each.filter(~F.col("outcome").isin(*ANSWERS) & (F.col("provider") != F.col("served_by")))
    return failed.groupBy(F.col("provider").alias("failed_provider"), "served_by").agg(F.count(F.lit(1)).alias("times"))


def run_totals(rows: DataFrame) -> DataFrame:
    """Totals of each run by outcome, and its status."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("companies"), n("ok").alias("ok"), n("no_news").alias("no_news"), n("refused").alias("refused"), n("error", "rate_limited").alias("failed"), n("skipped").alias("skipped"), F.sum("articles_new").cast("long").alias("articles_new"))
    served = F.col("ok") + F.col("no_news")
    return out.withColumn("status", F.when(served == 0, "failed").when(F.col("failed") + F.col("refused") + F.col("skipped") > 0, "partial").otherwise("succeeded"))


def run_company_rows(rows: DataFrame, companies: DataFrame, run_id: int, outcome: str | None, limit: int, offset: int = 0) -> DataFrame:
    out = rows.filter(F.col("run_id") == run_id)
    if outcome is not None:
        out = out.filter(F.col("outcome") == outcome)
    out = out.join(companies.select(F.col("id").alias("company_id"), "ticker", "company_name"), "company_id")
    return out.orderBy("ticker").offset(offset).limit(limit).select("ticker", "company_name", "provider", "outcome", "articles_new")


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", place).filter("__n = 1").drop("__n")


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins, as one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return out.select(*keys, "r.*")


def batch_newest(articles: DataFrame) -> DataFrame:
    return articles.agg(F.max("published_at").alias("newest"))


def staleness(runs: DataFrame, as_of, limit_hours: int = 36) -> DataFrame:
    """Hours since the last finished run (one decimal) and whether that is too long."""
    hours = F.round((F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(F.max("finished_at").cast("timestamp"))) / 3_600_000.0, 1)
    return runs.agg(hours.alias("hours")).withColumn("stale", F.coalesce(F.col("hours") > limit_hours, F.lit(True)))


# ---------------------------------------------------------------- connectivity and coverage


def definitive_answer() -> Column:
    """The row's own outcome if that is an answer, else the first answer among its attempts."""
    inner = F.get(F.filter("provider_attempts", lambda a: a["outcome"].isin(*ANSWERS)), 0)["outcome"]
    return F.when(F.col("outcome").isin(*DEFINITIVE), F.col("outcome")).otherwise(inner)


def latest_answers(rows: DataFrame, listings: DataFrame, as_of) -> DataFrame:
    """company_id, answer: of the newest run since the listings were last resolved (or of 14 days) that has an answer."""
    since = listings.groupBy("company_id").agg(F.max("resolved_at").alias("since"))
    seen = rows.withColumn("answer", definitive_answer()).filter("answer IS NOT NULL").join(since, "company_id", "left")
    seen = seen.filter(F.col("started_at") > F.coalesce("since", F.lit(as_of) - F.expr("INTERVAL 14 DAYS")))
    return seen.groupBy("company_id").agg(F.max_by("answer", "run_id").alias("answer"))


def connectivity(companies: DataFrame, links: DataFrame, answers: DataFrame) -> DataFrame:
    """state, companies and, for states that are faults, up to 50 tickers in order; inactive companies count too."""
    news = links.select(F.col("company_id").alias("id")).distinct().withColumn("news", F.lit(True))
    c = companies.join(news, "id", "left").join(answers.select(F.col("company_id").alias("id"), "answer"), "id", "left")
    state = F.when(F.col("resolution_status") != "resolved", "not_connected_unresolved").when(F.col("news"), "connected_has_news").when(F.col("answer") == "no_news", "connected_no_news_in_window").when(F.col("answer") == "skipped", "no_provider_covers_this_market").otherwise("no_definitive_answer")
    c = c.withColumn("state", state)
    # only the first fifty of a state are gathered
    place = F.row_number().over(Window.partitionBy("state").orderBy("ticker"))
    shown = c.filter(F.col("state").isin(*FAULTS)).withColumn("n", place).filter("n <= 50").groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"))
    return c.groupBy("state").agg(F.count(F.lit(1)).alias("companies")).join(shown, "state", "left").withColumn("tickers", F.coalesce("tickers", F.lit("")))


def listing_flags(listings: DataFrame) -> DataFrame:
    """Per company: any US line, any US line on an exchange, a US primary line."""
    us = F.col("is_us")
    return listings.groupBy("company_id").agg(F.bool_or(us).alias("us"), F.bool_or(us & (F.col("mic") != GONE_OTC)).alias("us_exchange"), F.bool_or(us & F.col("is_primary")).alias("us_primary"))


def flagged(companies: DataFrame, listings: DataFrame) -> DataFrame:
    f = listing_flags(listings)
    out = companies.join(f, companies["id"] == f["company_id"], "left").drop("company_id")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("us", "us_exchange", "us_primary")})


def metric_segment() -> Column:
    return F.when(F.col("resolution_status") != "resolved", "unresolved").when(F.col("us_exchange"), "US exchange listing").when(F.col("us"), "US OTC line only").otherwise("no US line")


def evaluation_segment() -> Column:
    return F.when(F.col("resolution_status") != "resolved", "unresolved").when(~F.col("us"), "no_us_line").when(~F.col("us_exchange"), "us_otc_only").otherwise("us_exchange_control")


def probe_segment() -> Column:
    return F.when(F.col("resolution_status") != "resolved", "unresolved").when(F.col("us_exchange") & F.col("us_primary"), "us_exchange").when(F.col("us_primary"), "us_otc").when(F.col("us"), "foreign_with_us_line").otherwise("foreign_only")


def shares(counted: DataFrame, measure: str, within: list[str] | None = None, digits: int = 1) -> DataFrame:
    """counted with pct, the share of measure in the whole or within keys; counted holds groups, so its window is small."""
    total = F.sum(measure).over(Window.partitionBy(*(within or [])))
    return counted.withColumn("pct", F.round(100.0 * F.col(measure).cast("double") / total.cast("double"), digits))


def segment_shares(companies: DataFrame, listings: DataFrame) -> DataFrame:
    seg = flagged(companies.filter("is_active"), listings).groupBy(metric_segment().alias("segment")).agg(F.count(F.lit(1)).alias("companies"))
    return shares(seg, "companies")


def coverage_stats(companies: DataFrame, links: DataFrame) -> DataFrame:
    """Companies, those with news, their share, and articles per company with news."""
    n = links.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    c = companies.filter("is_active")
    c = c.join(n, c["id"] == n["company_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = F.count_if(F.col("n") > 0)
    return c.agg(F.count(F.lit(1)).alias("companies"), some.alias("with_news"), F.round(100.0 * some.cast("double") / F.count(F.lit(1)), 1).alias("pct"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 1).alias("avg_articles"))


def ticker_native(links: DataFrame) -> DataFrame:
    """Articles with at least one link by ticker, and all articles with links."""
    each = links.groupBy("article_id").agg(F.bool_or(F.col("match_method") == "ticker").alias("native"))
    return each.agg(F.count_if("native").alias("native"), F.count(F.lit(1)).alias("articles"))


def gap_reason() -> Column:
    t, un = F.col("ticker"), F.col("resolution_status") != "resolved"
    return (
        F.when(un & F.col("covered_as").isNotNull(), "duplicate_listing_line")
        .when(un & (t.rlike("^0[A-Z0-9]{3}$") | t.endswith(".L")), "unresolved_london_secondary_line")
        .when(un & (t.endswith(".F") | t.endswith("_F")), "unresolved_frankfurt_line")
        .when(un & (t.endswith(".Y") | t.endswith("_Y")), "unresolved_depositary_line")
        .when(un & F.coalesce(F.col("resolution_note").startswith("rejected"), F.lit(False)), "unresolved_name_check_rejected")
        .when(un, "unresolved_absent_from_directory")
        .when(F.col("us_exchange"), "no_news_us_exchange")
        .when(F.col("us"), "no_news_otc_only")
        .otherwise("no_news_no_us_line")
    )


def coverage_gaps(companies: DataFrame, listings: DataFrame, links: DataFrame) -> DataFrame:
    """Companies without news and why; a resolved twin of the same name that has news is named."""
    served = links.select(F.col("company_id").alias("id")).distinct()
    twins = companies.filter("resolution_status = 'resolved'").join(served, "id", "left_semi").groupBy("name_normalized").agg(F.min("ticker").alias("covered_as"))
    gap = flagged(companies.join(served, "id", "left_anti"), listings)
    twin = twins.toDF("twin_name", "covered_as")
    gap = gap.join(twin, (gap["name_normalized"] == twin["twin_name"]) & (gap["resolution_status"] != "resolved"), "left")
    return gap.select("ticker", "company_name", "resolution_status", gap_reason().alias("gap_reason"), F.coalesce("covered_as", F.lit("")).alias("also_covered_as"), F.coalesce("resolution_note", F.lit("")).alias("note"))


def gap_export(companies: DataFrame, listings: DataFrame, links: DataFrame) -> DataFrame:
    """The coverage gaps with the companies' countries, as sinks.write_gaps takes them."""
    return coverage_gaps(companies, listings, links).join(companies.select("ticker", "country"), "ticker")


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash of the key."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def evaluation(rows: DataFrame) -> DataFrame:
    """Per provider and segment: requests by outcome, hit share of those not declined, articles per hit, mean latency."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = rows.groupBy("provider", "segment").agg(F.count(F.lit(1)).alias("n"), n("ok").alias("hit"), n("no_news").alias("none"), n("refused").alias("refused"), n("error", "rate_limited").alias("err"), n("skipped").alias("declined"), F.sum(F.when(F.col("outcome") == "ok", F.col("articles_new")).otherwise(0)).cast("long").alias("articles"), F.sum("ms").cast("long").alias("ms"))
    asked = F.col("n") - F.col("declined")
    return out.withColumns({"hit_pct": F.round(100.0 * F.col("hit").cast("double") / F.nullif(asked, F.lit(0)), 1), "per_hit": F.round(F.col("articles").cast("double") / F.nullif(F.col("hit"), F.lit(0)), 1), "mean_ms": F.round(F.col("ms").cast("double") / F.greatest(F.lit(1), asked), 1)}).drop("ms")


# ---------------------------------------------------------------- quotes, profiles, costs


def quote_gaps(quotes: DataFrame, key: str, ts: str, most: int = 300) -> DataFrame:
    """Segment number of each quote: a new one begins where more than ``most`` seconds lie between neighbours."""
    w = Window.partitionBy(key).orderBy(ts, "tie")
    gap = F.coalesce((F.col(ts) - F.lag(ts).over(w) > most).cast("int"), F.lit(0))
    return quotes.withColumn("gap", gap).withColumn("segment", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def book_levels(books: DataFrame, *keys: str) -> DataFrame:
    """Order-book levels: side, level (from 1), price, quantity."""
    side = lambda name, label: books.select(*keys, F.lit(label).alias("side"), F.posexplode(name).alias("i", "x")).select(*keys, "side", (F.col("i") + 1).alias("level"), F.col("x.px.value").cast("double").alias("price"), F.col("x.qty").cast("double").alias("quantity"))
    return side("bids", "bid").unionByName(side("offers", "offer"))


def first_sides(markets: DataFrame) -> DataFrame:
    """First long and first short side of each market (array sides of long, price) in one row."""
    pick = lambda flag: F.get(F.filter("sides", lambda s: s["long"] == flag), 0)
    return markets.select("market", pick(True)["price"].alias("yes_price"), pick(False)["price"].alias("no_price"))


def manifest_summary(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("other"), F.min("received_at").alias("first"), F.max("received_at").alias("last"))


def tagged_union(**frames: DataFrame) -> DataFrame:
    """Frames one after the other, each with its name as tag."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("tag", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def json_paths(docs: DataFrame, json_col: str, *keys: str, stage=None) -> DataFrame:
    """Leaves of JSON documents: path with [] for places, types, count and up to three distinct samples in order.

    Levels are taken apart one by one, as deep as the documents are; each step handles all
    rows of a level at once.  stage, a function that writes a frame and reads it back, has each
    level made once from the one above it, so that depth d costs d passes over what is left.
    """
    level = docs.select(*keys, F.lit("").alias("path"), F.parse_json(json_col).alias("v"))
    leaves = None
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT<") & (kind != "OBJECT<>") | (kind.startswith("ARRAY<") & ~kind.isin("ARRAY<>") & (F.to_json("v") != "[]"))
        level = level.withColumn("nested", nested)
        level = stage(level) if stage else level
        done = level.filter("NOT nested").select(*keys, F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), _json_type(kind).alias("type"), F.to_json("v").alias("sample"))
        leaves = done if leaves is None else leaves.unionByName(done)
        deeper = level.filter("nested")
        if deeper.isEmpty():
            break
        inner = docs.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("__key"), F.col("value").alias("__value"))
        opened = deeper.lateralJoin(inner).select(*keys, "path", "__key", F.col("__value").alias("v"))
        step = F.when(F.col("__key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), "__key"))
        level = opened.select(*keys, step.alias("path"), "v")
    typed = leaves.groupBy(*keys, "path").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys, "path").orderBy("sample"))
    some = leaves.select(*keys, "path", "sample").distinct().withColumn("i", place).filter("i <= 3").groupBy(*keys, "path").agg(F.array_join(F.array_sort(F.collect_list("sample")), "\n").alias("samples"))
    return typed.join(some, [*keys, "path"], "left")


def _json_type(kind: Column) -> Column:
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array (empty)").when(kind.startswith("OBJECT"), "object (empty)").otherwise("number")


def tool_costs(tools: DataFrame, users: int) -> DataFrame:
    """Monthly calls and cost of each tool (scope, polls, override, unit_price)."""
    n = F.when(F.col("scope") == "entity", F.greatest(F.lit(20), F.ceil(F.lit(users * 20 * 0.5)))).otherwise(1)
    keys = F.coalesce(F.nullif(F.col("override"), F.lit(0)), n)
    research = F.lit(users * 5 * 22)
    feed = F.when(F.col("scope") == "demand", research * 0.5).otherwise((keys * F.col("polls")).cast("double"))
    return tools.withColumns({"keys": keys.cast("long"), "research_calls": research.cast("long"), "feed_calls": feed.cast("double"), "research_cost": research * F.col("unit_price"), "feed_cost": feed * F.col("unit_price")})
