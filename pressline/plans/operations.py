"""Analytics queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import url
from pressline.operators import analytics as an
from pressline.operators import state
from pressline.plans.model import AFTER, DAY, Model, sql


def _day():
    return F.lit(DAY).cast("timestamp")


def _breakdown(spark, d):
    return an.provider_breakdown(Model(spark, d).run_rows)


def _fallthroughs(spark, d):
    return an.fallthroughs(Model(spark, d).run_rows)


def _totals(spark, d):
    return an.run_totals(Model(spark, d).run_rows)


def _rows(spark, d):
    m = Model(spark, d)
    return an.run_company_rows(m.run_rows, m.companies, 3, "error", 20, 5)


def _us_lines(m, only: str):
    """All listings; a line is a domestic one only where the condition holds too."""
    return m.listings.withColumn("is_us", F.col("is_us") & F.expr(only))


def _uneven_links(m, every: int):
    """All links; those of the companies whose id every divides into go to the company before, so they have no news."""
    return m.links.withColumn("company_id", F.col("company_id") - F.when(F.col("company_id") % every == every - 1, 1).otherwise(0))


def _connectivity(spark, d):
    m = Model(spark, d)
    answers = an.latest_answers(m.run_rows, m.listings, _day())
    return an.connectivity(m.companies, _uneven_links(m, 2), answers)


def _latest_outcome(spark, d):
    rows = Model(spark, d).run_rows.select("company_id", "run_id", "outcome")
    return an.latest_per_key(rows, ["company_id"], F.col("run_id").desc())


def _segments(spark, d):
    m = Model(spark, d)
    return an.segment_shares(m.companies, _us_lines(m, "company_id % 3 = 0"))


def _segment_ladders(spark, d):
    m = Model(spark, d)
    f = an.flagged(m.companies, _us_lines(m, "company_id % 3 = 0 AND (id % 11 = 0 OR mic = 'OOTC')"))
    return f.select("id", an.metric_segment().alias("metric"), an.evaluation_segment().alias("evaluation"), an.probe_segment().alias("probe"))


def _methods(spark, d):
    return an.shares(an.counts(Model(spark, d).links, "match_method"), "n")


def _tiers(spark, d):
    a = Model(spark, d).articles.groupBy("is_market_wide", "source_tier").agg(F.count(F.lit(1)).alias("n"))
    return an.shares(a, "n", ["is_market_wide"])


def _bands(spark, d):
    m = Model(spark, d)
    n = m.links.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("n") >= 450, "450 and more").when(F.col("n") >= 430, "430 to 449").otherwise("below 430")
    g = n.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("companies"), F.sum("n").cast("long").alias("articles"))
    return an.shares(g, "articles")


def _coverage(spark, d):
    m = Model(spark, d)
    return an.coverage_stats(m.companies, _uneven_links(m, 3))


def _native(spark, d):
    return an.ticker_native(Model(spark, d).links)


def _publishers(spark, d):
    return Model(spark, d).articles.groupBy("provider").agg(F.countDistinct("source").alias("sources"), F.countDistinct(url.publisher_domain(F.col("url"))).alias("domains"), F.count(F.lit(1)).alias("articles"))


def _domains(spark, d):
    pages = Model(spark, d).table("pages")
    return pages.groupBy(url.publisher_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def _gaps(spark, d):
    m = Model(spark, d)
    return an.coverage_gaps(m.companies, _us_lines(m, "company_id % 3 <> 1"), _uneven_links(m, 2))


def _gap_counts(spark, d):
    return an.counts(_gaps(spark, d), "gap_reason")


def _sample(spark, d):
    m = Model(spark, d)
    seg = an.flagged(m.companies.filter("is_active"), _us_lines(m, "company_id % 3 = 0")).select("id", "ticker", an.evaluation_segment().alias("segment"))
    return an.stratified_sample(seg, "segment", "id", 4, "0.42:").select("segment", "ticker", "place")


def _evaluation(spark, d):
    m = Model(spark, d)
    seg = an.flagged(m.companies, _us_lines(m, "company_id % 3 = 0")).select(F.col("id").alias("company_id"), an.evaluation_segment().alias("segment"))
    return an.evaluation(m.run_events.join(seg, "company_id"))


def _quotes(spark, d):
    e = Model(spark, d).table("events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("tie"), "value")
    g = an.quote_gaps(e, "user_id", "t", most=43200)
    return g.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("quotes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def _paths(spark, d):
    return an.json_paths(Model(spark, d).table("events"), "props", "event_type")


def _mixed_paths(spark, d):
    """Paths of documents with arrays in arrays, nulls, empty objects and values of several types."""
    from pressline.plans.stateful import staged

    n = F.col("event_id")
    inner = F.when(n % 3 == 0, "1.5").when(n % 3 == 1, '"s"').otherwise("{}")
    text = F.concat(F.lit('{"k":'), n.cast("string"), F.lit(',"a":['), (n % 3).cast("string"), F.lit(',null,"x",[true,[]]],"o":{"d":'), inner, F.lit('},"n":null,"p":'), "props", F.lit("}"))
    paths = an.json_paths(Model(spark, d).table("events").select("event_type", text.alias("j")), "j", "event_type", stage=staged(spark, "paths"))
    return paths.select("event_type", "path", "types", "n")


def _tools(spark, d):
    p = Model(spark, d).table("part")
    scope = F.when(F.col("p_size") % 3 == 0, "entity").when(F.col("p_size") % 3 == 1, "demand").otherwise("global")
    return p.select(F.col("p_partkey").alias("tool"), F.col("p_brand").alias("family"), scope.alias("scope"), (F.col("p_size") % 30 + 1).alias("polls"), F.when(F.col("p_size") % 7 == 0, 55).alias("override"), (F.round(F.col("p_retailprice")).cast("long") / 1024).alias("unit_price"))


def _costs(spark, d):
    c = an.tool_costs(_tools(spark, d), 100)
    return c.groupBy("family").agg(F.sum("keys").cast("long").alias("keys"), F.sum("feed_calls").alias("feed_calls"), F.sum("research_cost").alias("research_cost"), F.sum("feed_cost").alias("feed_cost"))


def _book(spark, d):
    li = Model(spark, d).table("lineitem")
    item = F.struct(F.struct(F.col("l_extendedprice").cast("string").alias("value"), F.lit("USD").alias("currency")).alias("px"), F.col("l_quantity").cast("string").alias("qty"))
    tie = F.struct(F.col("l_extendedprice"), F.col("l_quantity"), item.alias("x"))
    b = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == "O", tie))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == "F", tie))).alias("o"))
    books = b.select(F.col("l_orderkey").alias("market"), F.transform("b", lambda t: t["x"]).alias("bids"), F.transform("o", lambda t: t["x"]).alias("offers"))
    return an.book_levels(books, "market").select("market", "side", F.col("level").cast("long").alias("level"), "price", "quantity")


def _sides(spark, d):
    li = Model(spark, d).table("lineitem")
    one = F.struct("l_linenumber", "l_extendedprice", (F.col("l_linestatus") == "O").alias("long"), F.col("l_quantity").alias("price"))
    return an.first_sides(li.groupBy(F.col("l_orderkey").alias("market")).agg(F.array_sort(F.collect_list(one)).alias("sides")))


def _manifest(spark, d):
    e = Model(spark, d).table("events").select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("received_at"))
    return an.manifest_summary(e)


def _two_windows(spark, d):
    e = Model(spark, d).table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    day, week = e.filter("ts >= '2024-01-30' "), e.filter("ts >= '2024-01-24'")
    return an.tagged_union(day=day, week=week).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _stale(spark, d):
    runs = Model(spark, d).run_rows.groupBy("run_id").agg(F.max("at").alias("finished_at"))
    return an.staleness(runs, AFTER)


def _fetch_state(spark, d):
    ev = Model(spark, d).run_events
    rows = ev.select("company_id", "provider", "seq", "at", F.col("outcome").isin("ok", "no_news").alias("ok"), F.when(F.col("outcome") == "ok", F.col("at")).alias("newest"))
    out = state.fetch_state(rows)
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("company_id", "provider", t("last_success_at"), t("last_article_at"), "consecutive_failures", t("suppressed_until"))


def _windows(spark, d):
    last = Model(spark, d).run_events.filter("outcome = 'ok'").groupBy("company_id").agg(F.max("at").alias("last"))
    as_of = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return last.select("company_id", F.date_format(state.fetch_from(F.when(F.col("company_id") % 5 != 0, F.col("last")), as_of), "yyyy-MM-dd HH:mm:ss").alias("fetch_from"))


def _cascade(spark, d):
    rows = Model(spark, d).run_rows
    return rows.groupBy(state.cascade_outcome(F.col("provider_attempts"), F.array(F.lit("p0"), F.lit("p1"))).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_LATEST = f"""since AS (SELECT company_id, max(resolved_at) AS since FROM listings GROUP BY 1),
ans AS (SELECT r.company_id, run_id, started_at, CASE WHEN outcome IN ('ok', 'no_news', 'skipped') THEN outcome WHEN second IN ('ok', 'no_news') THEN second END AS answer FROM run_rows r),
latest AS (SELECT a.company_id, answer FROM ans a LEFT JOIN since s USING (company_id) WHERE answer IS NOT NULL AND started_at > coalesce(since, TIMESTAMP '{DAY}' - INTERVAL 14 DAY) QUALIFY row_number() OVER (PARTITION BY a.company_id ORDER BY run_id DESC) = 1)"""
_FLAGS = """f AS (SELECT company_id, bool_or(is_us) AS us, bool_or(is_us AND mic <> 'OOTC') AS us_exchange, bool_or(is_us AND is_primary) AS us_primary FROM (SELECT * REPLACE (is_us AND ({0}) AS is_us) FROM listings) GROUP BY 1),
g AS (SELECT c.*, coalesce(us, FALSE) AS us, coalesce(us_exchange, FALSE) AS us_exchange, coalesce(us_primary, FALSE) AS us_primary FROM companies c LEFT JOIN f ON f.company_id = c.id)"""
_METRIC = "CASE WHEN resolution_status <> 'resolved' THEN 'unresolved' WHEN us_exchange THEN 'US exchange listing' WHEN us THEN 'US OTC line only' ELSE 'no US line' END"
_EVAL = "CASE WHEN resolution_status <> 'resolved' THEN 'unresolved' WHEN NOT us THEN 'no_us_line' WHEN NOT us_exchange THEN 'us_otc_only' ELSE 'us_exchange_control' END"
_PROBE = "CASE WHEN resolution_status <> 'resolved' THEN 'unresolved' WHEN us_exchange AND us_primary THEN 'us_exchange' WHEN us_primary THEN 'us_otc' WHEN us THEN 'foreign_with_us_line' ELSE 'foreign_only' END"
_GAP = f"""WITH {_FLAGS.format("company_id % 3 <> 1")},
served AS (SELECT DISTINCT company_id - company_id % 2 AS company_id FROM links),
tw AS (SELECT name_normalized AS nn, min(ticker) AS covered_as FROM companies WHERE resolution_status = 'resolved' AND id IN (SELECT company_id FROM served) GROUP BY 1),
gap AS (SELECT ticker, company_name, resolution_status, CASE WHEN resolution_status <> 'resolved' AND covered_as IS NOT NULL THEN 'duplicate_listing_line'
  WHEN resolution_status <> 'resolved' AND (regexp_matches(ticker, '^0[A-Z0-9]{{3}}$') OR ticker LIKE '%.L') THEN 'unresolved_london_secondary_line'
  WHEN resolution_status <> 'resolved' AND (ticker LIKE '%.F' OR ends_with(ticker, '_F')) THEN 'unresolved_frankfurt_line'
  WHEN resolution_status <> 'resolved' AND (ticker LIKE '%.Y' OR ends_with(ticker, '_Y')) THEN 'unresolved_depositary_line'
  WHEN resolution_status <> 'resolved' AND resolution_note LIKE 'rejected%' THEN 'unresolved_name_check_rejected'
  WHEN resolution_status <> 'resolved' THEN 'unresolved_absent_from_directory' WHEN us_exchange THEN 'no_news_us_exchange' WHEN us THEN 'no_news_otc_only' ELSE 'no_news_no_us_line' END AS gap_reason,
  coalesce(covered_as, '') AS also_covered_as, coalesce(resolution_note, '') AS note
  FROM g LEFT JOIN tw ON tw.nn = g.name_normalized AND g.resolution_status <> 'resolved' WHERE g.id NOT IN (SELECT company_id FROM served))
"""
_TOOLS = """t AS (SELECT p_partkey, p_brand AS family, CASE p_size % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'demand' ELSE 'global' END AS scope, p_size % 30 + 1 AS polls, CASE WHEN p_size % 7 = 0 THEN 55 END AS o, CAST(round(p_retailprice) AS BIGINT) / 1024.0::DOUBLE AS price FROM part),
u AS (SELECT *, coalesce(o, CASE WHEN scope = 'entity' THEN 1000 ELSE 1 END) AS keys FROM t),
w AS (SELECT *, CASE WHEN scope = 'demand' THEN 5500.0::DOUBLE ELSE (keys * polls)::DOUBLE END AS feed FROM u)"""

QUERIES = {
    "run_provider_breakdown": (_breakdown, sql("SELECT provider, outcome, count(*) AS companies, CAST(sum(articles_new) AS BIGINT) AS articles FROM run_rows GROUP BY 1, 2", "run_rows")),
    "run_fallthroughs": (_fallthroughs, sql("""WITH a AS (SELECT provider AS served_by, p1 AS p, outcome AS o FROM run_rows UNION ALL SELECT provider, provider, second FROM run_rows)
SELECT p AS failed_provider, served_by, count(*) AS times FROM a WHERE o NOT IN ('ok', 'no_news') AND p <> served_by GROUP BY 1, 2""", "run_rows")),
    "run_totals_status": (_totals, sql("""WITH t AS (SELECT run_id, count(*) AS companies, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'no_news') AS no_news, count(*) FILTER (WHERE outcome = 'refused') AS refused,
  count(*) FILTER (WHERE outcome IN ('error', 'rate_limited')) AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, CAST(sum(articles_new) AS BIGINT) AS articles_new FROM run_rows GROUP BY 1)
SELECT *, CASE WHEN ok + no_news = 0 THEN 'failed' WHEN failed + refused + skipped > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM t""", "run_rows")),
    "run_company_rows": (_rows, sql("SELECT ticker, company_name, provider, outcome, articles_new FROM run_rows r JOIN companies c ON c.id = r.company_id WHERE run_id = 3 AND outcome = 'error' ORDER BY ticker LIMIT 20 OFFSET 5", "run_rows", "companies")),
    "connectivity_states": (_connectivity, sql(f"""WITH {_LATEST},
k AS (SELECT ticker, CASE WHEN resolution_status <> 'resolved' THEN 'not_connected_unresolved' WHEN id IN (SELECT company_id - company_id % 2 FROM links) THEN 'connected_has_news' WHEN answer = 'no_news' THEN 'connected_no_news_in_window'
  WHEN answer = 'skipped' THEN 'no_provider_covers_this_market' ELSE 'no_definitive_answer' END AS state FROM companies c LEFT JOIN latest l ON l.company_id = c.id)
SELECT state, count(*) AS companies, CASE WHEN state IN ('not_connected_unresolved', 'no_definitive_answer', 'no_provider_covers_this_market') THEN array_to_string(list_slice(list(ticker ORDER BY ticker), 1, 50), ',') ELSE '' END AS tickers FROM k GROUP BY state""", "run_rows", "listings", "links", "companies")),
    "latest_outcome_per_company": (_latest_outcome, sql("SELECT company_id, run_id, outcome FROM run_rows QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY run_id DESC) = 1", "run_rows")),
    "segment_shares": (_segments, sql(f"WITH {_FLAGS.format('company_id % 3 = 0')} SELECT {_METRIC} AS segment, count(*) AS companies, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM g WHERE is_active GROUP BY 1", "companies", "listings")),
    "segment_ladders": (_segment_ladders, sql(f"WITH {_FLAGS.format(chr(39).join(('company_id % 3 = 0 AND (id % 11 = 0 OR mic = ', 'OOTC', ')')))} SELECT id, {_METRIC} AS metric, {_EVAL} AS evaluation, {_PROBE} AS probe FROM g", "companies", "listings")),
    "match_method_shares": (_methods, sql("SELECT match_method, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM links GROUP BY 1", "links")),
    "tier_by_feed_shares": (_tiers, sql("SELECT is_market_wide, source_tier, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY is_market_wide), 1) AS pct FROM articles GROUP BY 1, 2", "articles")),
    "news_velocity_bands": (_bands, sql("""WITH n AS (SELECT company_id, count(*) AS n FROM links GROUP BY 1), b AS (SELECT CASE WHEN n >= 450 THEN '450 and more' WHEN n >= 430 THEN '430 to 449' ELSE 'below 430' END AS band, count(*) AS companies, CAST(sum(n) AS BIGINT) AS articles FROM n GROUP BY 1)
SELECT *, round(100.0 * articles::DOUBLE / sum(articles) OVER (), 1) AS pct FROM b""", "links")),
    "coverage_stats": (_coverage, sql("""WITH n AS (SELECT c.id, (SELECT count(*) FROM links l WHERE l.company_id - CAST(l.company_id % 3 = 2 AS INTEGER) = c.id) AS n FROM companies c WHERE is_active)
SELECT count(*) AS companies, count(*) FILTER (WHERE n > 0) AS with_news, round(100.0 * (count(*) FILTER (WHERE n > 0))::DOUBLE / count(*), 1) AS pct, round(avg(n) FILTER (WHERE n > 0), 1) AS avg_articles FROM n""", "companies", "links")),
    "ticker_native_articles": (_native, sql("WITH e AS (SELECT article_id, bool_or(match_method = 'ticker') AS t FROM links GROUP BY 1) SELECT count(*) FILTER (WHERE t) AS native, count(*) AS articles FROM e", "links")),
    "publishers_by_provider": (_publishers, sql("SELECT provider, count(DISTINCT source) AS sources, count(DISTINCT split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1)) AS domains, count(*) AS articles FROM articles GROUP BY 1", "articles")),
    "publisher_domains": (_domains, "SELECT split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1"),
    "coverage_gaps": (_gaps, sql(_GAP + "SELECT * FROM gap", "companies", "listings", "links")),
    "gap_reason_counts": (_gap_counts, sql(_GAP + "SELECT gap_reason, count(*) AS n FROM gap GROUP BY 1", "companies", "listings", "links")),
    "stratified_sample": (_sample, sql(f"""WITH {_FLAGS.format('company_id % 3 = 0')}, r AS (SELECT {_EVAL} AS segment, ticker, CAST(row_number() OVER (PARTITION BY {_EVAL} ORDER BY sha256('0.42:' || id), id) AS INTEGER) AS place FROM g WHERE is_active) SELECT * FROM r WHERE place <= 4""", "companies", "listings")),
    "provider_evaluation": (_evaluation, sql(f"""WITH {_FLAGS.format('company_id % 3 = 0')},
e AS (SELECT provider, {_EVAL} AS segment, count(*) AS n, count(*) FILTER (WHERE outcome = 'ok') AS hit, count(*) FILTER (WHERE outcome = 'no_news') AS none, count(*) FILTER (WHERE outcome = 'refused') AS refused, count(*) FILTER (WHERE outcome IN ('error', 'rate_limited')) AS err,
  count(*) FILTER (WHERE outcome = 'skipped') AS declined, CAST(coalesce(sum(articles_new) FILTER (WHERE outcome = 'ok'), 0) AS BIGINT) AS articles, sum(ms) AS ms FROM run_events r JOIN g ON g.id = r.company_id GROUP BY 1, 2)
SELECT provider, segment, n, hit, none, refused, err, declined, articles, round(100.0 * hit::DOUBLE / nullif(n - declined, 0), 1) AS hit_pct, round(articles::DOUBLE / nullif(hit, 0), 1) AS per_hit, round(ms::DOUBLE / greatest(1, n - declined), 1) AS mean_ms FROM e""", "companies", "listings", "run_events")),
    "quote_gap_segments": (_quotes, """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS gap FROM e),
s AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g)
SELECT user_id, segment, count(*) AS quotes, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY 1, 2"""),
    "json_mixed_paths": (_mixed_paths, """WITH l AS (SELECT event_type, unnest([
  {'p': 'k', 't': 'number'}, {'p': 'a[]', 't': 'number'}, {'p': 'a[]', 't': 'null'}, {'p': 'a[]', 't': 'string'}, {'p': 'a[][]', 't': 'boolean'}, {'p': 'a[][]', 't': 'array (empty)'}, {'p': 'n', 't': 'null'}, {'p': 'p.k', 't': 'number'},
  {'p': 'o.d', 't': CASE event_id % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'object (empty)' END}]) AS x FROM events)
SELECT event_type, x.p AS path, string_agg(DISTINCT x.t, ', ' ORDER BY x.t) AS types, count(*) AS n FROM l GROUP BY 1, 2"""),
    "json_path_profile": (_paths, """WITH v AS (SELECT event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS s FROM events),
d AS (SELECT DISTINCT event_type, s FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s) AS i FROM d)
SELECT event_type, 'k' AS path, 'number' AS types, count(*) AS n, (SELECT string_agg(s, chr(10) ORDER BY s) FROM r WHERE r.event_type = v.event_type AND i <= 3) AS samples FROM v GROUP BY event_type"""),
    "tool_cost_scenario": (_costs, f"WITH {_TOOLS} SELECT family, CAST(sum(keys) AS BIGINT) AS keys, sum(feed) AS feed_calls, sum(11000 * price) AS research_cost, sum(feed * price) AS feed_cost FROM w GROUP BY 1"),
    "order_book_levels": (_book, """SELECT l_orderkey AS market, CASE l_linestatus WHEN 'O' THEN 'bid' ELSE 'offer' END AS side, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_extendedprice, l_quantity) AS level, l_extendedprice AS price, l_quantity AS quantity FROM lineitem"""),
    "outcome_sides": (_sides, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT l_orderkey AS market, max(l_quantity) FILTER (WHERE i = 1 AND l_linestatus = 'O') AS yes_price, max(l_quantity) FILTER (WHERE i = 1 AND l_linestatus = 'F') AS no_price FROM r GROUP BY 1"""),
    "manifest_summary": (_manifest, "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS other, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events"),
    "history_windows_union": (_two_windows, "SELECT 'day' AS tag, count(*) AS n FROM events WHERE ts >= '2024-01-30' UNION ALL SELECT 'week', count(*) FROM events WHERE ts >= '2024-01-24'"),
    "run_staleness": (_stale, sql(f"WITH f AS (SELECT max(at_ts) AS t FROM run_rows) SELECT round((epoch_ms(TIMESTAMP '{AFTER}') - epoch_ms(t)) / 3600000.0, 1) AS hours, round((epoch_ms(TIMESTAMP '{AFTER}') - epoch_ms(t)) / 3600000.0, 1) > 36 AS stale FROM f", "run_rows")),
    "fetch_state_fold": (_fetch_state, sql("""WITH o AS (SELECT *, outcome IN ('ok', 'no_news') AS ok FROM run_events),
l AS (SELECT company_id, provider, max(seq) FILTER (WHERE ok) AS last_ok FROM o GROUP BY 1, 2),
s AS (SELECT o.company_id, o.provider, max(at_ts) FILTER (WHERE ok) AS succ, max(at_ts) FILTER (WHERE outcome = 'ok') AS art, count(*) FILTER (WHERE seq > coalesce(last_ok, -1)) AS fails, max(at_ts) FILTER (WHERE seq > coalesce(last_ok, -1)) AS failed_at FROM o JOIN l USING (company_id, provider) GROUP BY 1, 2)
SELECT company_id, provider, strftime(succ, '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(art, '%Y-%m-%d %H:%M:%S') AS last_article_at, fails AS consecutive_failures, CASE WHEN fails >= 5 THEN strftime(failed_at + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') END AS suppressed_until FROM s""", "run_events")),
    "fetch_windows": (_windows, sql("""SELECT company_id, strftime(CASE WHEN company_id % 5 = 0 THEN TIMESTAMP '2024-02-10' - INTERVAL 90 DAY ELSE greatest(max(at_ts) - INTERVAL 6 HOUR, TIMESTAMP '2024-02-10' - INTERVAL 30 DAY) END, '%Y-%m-%d %H:%M:%S') AS fetch_from FROM run_events WHERE outcome = 'ok' GROUP BY company_id""", "run_events")),
    "provider_cascade": (_cascade, sql("""WITH x AS (SELECT outcome AS a, second AS b, p1 IN ('p0', 'p1') AS a1, provider IN ('p0', 'p1') AS a2 FROM run_rows),
y AS (SELECT CASE WHEN 'ok' IN (a, b) THEN 'ok' WHEN a NOT IN ('ok', 'no_news', 'skipped') THEN a
  WHEN b NOT IN ('ok', 'no_news', 'skipped') AND NOT (a = 'no_news' AND a1) THEN b WHEN 'no_news' IN (a, b) THEN 'no_news' ELSE 'skipped' END AS outcome FROM x)
SELECT outcome, count(*) AS n FROM y GROUP BY 1""", "run_rows")),
}
