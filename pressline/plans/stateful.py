"""Resolution, state and streaming queries; oracles where SQL has the semantics."""

from __future__ import annotations

import tempfile
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressline.functions import exchange, names, url
from pressline.operators import resolution, state, v2
from pressline.plans.content import _PLAIN
from pressline.plans.model import Model, sql
from pressline.sources import files
from pressline.streaming import jobs

_C = F.col


def shared_folder(spark, name: str) -> str:
    """A fresh folder that all executors see: below the session's checkpoint folder, or a temporary one of a local session."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pressline-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(spark, name: str):
    """A function that writes a frame into a shared folder and reads it back."""

    def stage(df):
        folder = shared_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    return stage


def _hints(spark, d):
    m = Model(spark, d)
    ls = m.listings
    n = _C("id")
    c = m.companies
    one = c.select(n.alias("hint_id"), F.when(n % 2 == 0, _C("ticker")).alias("ticker"), F.when(n % 3 == 0, F.upper("company_name")).when(n % 3 == 1, F.concat("company_name", F.lit(" "))).alias("name"), F.when(n % 5 == 0, _C("country")).alias("country"), F.when(n % 7 == 0, F.lit("NYSE")).alias("exchange"))
    return v2.resolve_hints(one, c, ls)


def _hint_oracle():
    return sql("""WITH h AS (SELECT id AS hint_id, upper(CASE WHEN id % 2 = 0 THEN ticker ELSE '' END) AS ht, trim(CASE id % 3 WHEN 0 THEN upper(company_name) WHEN 1 THEN company_name ELSE '' END) AS hn, CASE WHEN id % 5 = 0 THEN upper(country) ELSE '' END AS hc, CASE WHEN id % 7 = 0 THEN 'XNYS' ELSE '' END AS he FROM companies),
k AS (SELECT DISTINCT company_id, upper(symbol) AS sym, mic, exchange_code FROM listings),
m AS (SELECT h.*, c.id, c.company_name FROM h JOIN companies c ON c.is_active AND (ht <> '' OR hn <> '') AND (ht = '' OR upper(c.ticker) = ht OR EXISTS (SELECT 1 FROM k WHERE k.company_id = c.id AND k.sym = ht))
  AND (hn = '' OR lower(c.company_name) = lower(hn) OR (ht <> '' AND hn <> '' AND hc <> '' AND he <> '')) AND (hc = '' OR upper(c.country) = hc) AND (he = '' OR EXISTS (SELECT 1 FROM k WHERE k.company_id = c.id AND (k.mic = he OR k.exchange_code = he) AND (ht = '' OR k.sym = ht)))
  QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY c.id) <= 6),
g AS (SELECT hint_id, count(*) AS n, min(id) AS cid FROM m WHERE hn = '' OR lower(company_name) = lower(hn) GROUP BY 1),
f AS (SELECT h.hint_id, coalesce(n, 0) AS candidates, cid, hn <> '' OR he <> '' OR (hc <> '' AND ht <> '') AS grounded FROM h LEFT JOIN g USING (hint_id))
SELECT hint_id, CASE WHEN candidates = 1 AND grounded THEN 'matched' WHEN candidates > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN candidates = 1 AND grounded THEN cid END AS company_id, candidates FROM f""", "companies", "listings")


def _aliases(m):
    n = _C("id")
    return m.companies.select(n.alias("company_id"), F.concat(F.lit("trade name "), n.cast("string")).alias("alias_name"), F.concat("company_name", F.when(n % 2 == 0, " Inc").otherwise("")).alias("issuer_name"), F.upper("ticker").alias("ticker"), F.lit("XLON").alias("mic"), F.upper("country").alias("country"), (n % 9 != 0).alias("enabled"), (n % 4 == 0).alias("requires_listing"), F.date_add(F.lit(date(2024, 1, 1)), (n % 40).cast("int")).alias("checked_at"), F.date_add(F.lit(date(2024, 1, 20)), (n % 40).cast("int")).alias("valid_until"))


def _alias_validity(spark, d):
    return v2.usable_aliases(_aliases(Model(spark, d)), date(2024, 1, 25)).select("company_id", "alias_name")


def _alias_matches(spark, d):
    m = Model(spark, d)
    own = m.companies.select(_C("id").alias("company_id"), F.col("ticker").alias("symbol"), F.lit("XLON").alias("mic"), F.lit("LN").alias("exchange_code"))
    twin = m.companies.filter("id % 6 = 0").select((_C("id") + 1).alias("company_id"), F.col("ticker").alias("symbol"), F.lit("XLON").alias("mic"), F.lit("LN").alias("exchange_code"))
    n = _C("id")
    hints = m.companies.select(n.alias("hint_id"), "ticker", F.lit("lse").alias("exchange"), "country", F.concat(F.lit("Trade-Name "), n.cast("string"), F.lit(" plc")).alias("name"))
    return v2.alias_matches(hints, _aliases(m), m.companies, own.unionByName(twin), date(2024, 1, 25))


def _directory(m):
    """Parts as a symbol directory."""
    v = _C("p_size") % 6
    mic = F.when(v == 0, "XNYS").when(v == 1, "XNAS").when(v == 2, "OOTC").when(v == 3, "ARCX").otherwise("XLON")
    rows = m.table("part").select(F.concat(F.lit("P"), (_C("p_partkey") % 700).cast("string")).alias("symbol"), F.concat(F.col("p_name"), F.lit(" inc")).alias("description"), F.when(_C("p_type") == "PROMO", "ADR").otherwise("Common Stock").alias("type"), mic.alias("mic"), F.concat(F.lit("F"), _C("p_partkey").cast("string")).alias("figi"))
    return files.us_directory(rows, least=100)


def _us_directory(spark, d):
    return _directory(Model(spark, d)).groupBy("mic").agg(F.count(F.lit(1)).alias("n"), F.min("venue_rank").cast("long").alias("rank"), F.bool_or("exchange_listed").alias("listed"), F.count_if(exchange.classify_security(_C("type"), _C("description")) == "adr").alias("adrs"))


def _resolution_tables(m):
    """All parts as companies, as a directory of every third symbol and as identifiers on venues.

    Names are two words of the part's name; a company's may be shortened, prolonged or changed in one word.
    """
    n, name = _C("p_partkey"), F.col("p_name")
    one, two = F.split(name, " ")[0], F.split(name, " ")[1]
    part = m.table("part")
    hint = F.when(n % 5 == 1, "LSE").when(n % 5 == 2, "NYSE").when(n % 5 == 3, "XTRA").when(n % 5 == 4, "NOWHERE")
    called = F.when(n % 4 == 1, F.concat(name, F.lit(" plc"))).when(n % 4 == 2, F.concat(one, F.lit(" brightwater"))).when(n % 4 == 3, F.concat(name, F.lit(" tavkozlesi overseas"))).otherwise(F.concat(F.lit("quillfeather "), n.cast("string")))
    symbol = F.concat(F.lit("P"), n.cast("string"))
    ticker = F.when(n % 7 == 6, F.concat(F.lit("Z"), n.cast("string"))).otherwise(F.lower(symbol))
    companies = part.select(n.alias("id"), ticker.alias("ticker"), called.alias("company_name"), hint.alias("exchange_hint"), (n % 2 == 0).alias("is_us_listed"))
    share = F.concat(F.lit("S"), F.floor(n / 2).cast("string"))
    mic = F.when(n % 2 == 0, "XNYS").otherwise("OOTC")
    directory = part.filter(n % 3 == 0).select(symbol.alias("symbol"), F.concat(F.lower(name), F.lit(" "), (n % 50).cast("string"), F.lit("x inc")).alias("description"), mic.alias("mic"), share.alias("share_class"), F.concat(F.lit("F"), n.cast("string")).alias("figi"), F.lit("Common Stock").alias("type"))
    venue = F.when(n % 6 == 1, "LN").when(n % 6 == 2, "GY").when(n % 6 == 4, "SS").when(n % 6 == 5, "QQ").otherwise("JT")
    ids = part.select(n.alias("place"), symbol.alias("symbol"), venue.alias("exchange_code"), name.alias("name"), F.lit("Common Stock").alias("type1"), F.when(n % 11 == 0, "Option").otherwise("Common Stock").alias("type2"), F.concat(F.lit("F"), n.cast("string")).alias("figi"), F.lit(None).cast("string").alias("composite"), share.alias("share_class"))
    return companies, files.us_directory(directory, least=10), ids


def _cascade(spark, d):
    from pressline.operators import cascade

    companies, directory, ids = _resolution_tables(Model(spark, d))
    return cascade.statuses(companies, directory, ids, staged(spark, "cascade")).withColumn("confidence", F.round("confidence", 6))


def _cascade_lines(spark, d):
    from pressline.operators import cascade

    companies, directory, ids = _resolution_tables(Model(spark, d))
    return cascade.resolve(companies, directory, ids, staged(spark, "cascade")).filter("symbol IS NOT NULL").select("company_id", "exchange_code", "symbol", "mic", "is_us", "is_primary", F.round("confidence", 6).alias("confidence"))


def _best(spark, d):
    ls = Model(spark, d).listings
    quality = exchange.listing_quality(_C("exchange_code"), _C("symbol"), _C("id").cast("string"), F.when(_C("id") % 4 == 0, _C("id").cast("string")), F.lit("SE"))
    c = ls.select("company_id", "symbol", (0.5 + (_C("id") % 50) / 100.0).alias("score"), quality.alias("quality"))
    return resolution.best_candidate(c).select("company_id", "symbol", F.round("score", 6).alias("score"), _C("quality").cast("long").alias("quality"))


def _expand(spark, d):
    """Of each company its first line as what was resolved, a third of the others as siblings, the rest as known lines."""
    ls = Model(spark, d).listings.select("company_id", "exchange_code", "symbol", "mic", "is_us", "is_primary", _C("confidence").cast("double").alias("confidence"), "id", (_C("id") == F.min("id").over(Window.partitionBy("company_id"))).alias("first"))
    primary = ls.filter("first").withColumn("is_primary", F.lit(True))
    hints = Model(spark, d).companies.select(_C("id").alias("company_id"), exchange.hint_field(_C("exchange_hint"), "code").alias("hint_code"))
    return resolution.expand(primary, ls.filter("NOT first AND id % 3 = 0"), ls.filter("NOT first AND id % 3 <> 0").withColumn("is_primary", F.lit(False)), hints).select("company_id", "exchange_code", "symbol", "is_us", "is_primary", F.round("confidence", 6).alias("confidence"))


def _asserted(spark, d):
    m = Model(spark, d)
    ls = m.listings.select("company_id", "exchange_code", "symbol", "mic", (_C("is_us") & (_C("company_id") % 14 != 0)).alias("is_us"), "is_primary", _C("confidence").cast("double").alias("confidence"))
    out = resolution.with_asserted(ls, resolution.asserted_us(m.companies, ls))
    return out.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("primaries"), F.count_if(_C("confidence") == 0.5).alias("asserted_or_half"))


def _symbol_owner(spark, d):
    return resolution.first_per_symbol(Model(spark, d).listings)


def _us_symbols(spark, d):
    u = resolution.us_symbols(Model(spark, d).listings)
    return u.select("company_id", F.size("symbols").cast("long").alias("n"), F.coalesce(F.get("symbols", 0), F.lit("")).alias("first"))


def _batch(m):
    """Lineitems as an ingest batch: stories of companies, with repeats."""
    n = _C("l_orderkey")
    return m.table("lineitem").select(_C("l_suppkey").alias("company_id"), F.concat(F.lit("u"), (n % 4000).cast("string")).alias("dedupe_hash"), F.concat(F.lit("c"), (n % 2500).cast("string")).alias("content_hash"), ((_C("l_partkey") % 100) / 100.0).alias("relevance"), (n * 100_000_000 + _C("l_partkey") * 1000 + F.round(_C("l_quantity")).cast("long") * 10 + _C("l_linenumber")).alias("seq"))


def _verdicts(spark, d):
    m = Model(spark, d)
    batch = _batch(m).groupBy("seq").agg(F.min(F.struct("company_id", "dedupe_hash", "content_hash", "relevance")).alias("r")).select("seq", "r.*")
    stored = spark.range(0, 4000, 7).select(F.concat(F.lit("u"), _C("id").cast("string")).alias("dedupe_hash"), F.concat(F.lit("c"), (_C("id") % 2500).cast("string")).alias("content_hash"))
    links = stored.select("dedupe_hash", (F.regexp_extract("dedupe_hash", "[0-9]+", 0).cast("long") % 50).alias("company_id"))
    return state.store_verdicts(batch, stored, links)


def _store_rows(spark, d):
    return _verdicts(spark, d).select("seq", "company_id", "verdict", "inserted", "linked")


def _store(spark, d):
    return state.store_stats(_verdicts(spark, d), "company_id")


# A row is skipped only for a story that is stored for the company or that an earlier row of its batch was kept for.
_STORE_ROWS = """WITH b0 AS (
  SELECT l_suppkey AS company_id, 'u' || (l_orderkey % 4000) AS dh, 'c' || (l_orderkey % 2500) AS ch, (l_partkey % 100) / 100.0::DOUBLE AS rel,
    l_orderkey * 100000000 + l_partkey * 1000 + CAST(round(l_quantity) AS BIGINT) * 10 + l_linenumber AS seq FROM lineitem),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY company_id, dh, ch, rel) = 1),
st AS (SELECT 'u' || i AS dh, 'c' || (i % 2500) AS ch, i % 50 AS company_id FROM range(0, 4000, 7) t(i)),
u AS (SELECT *, seq = min(seq) OVER (PARTITION BY company_id, dh) AS fresh FROM b),
good AS (SELECT company_id, ch, min(seq) AS at FROM u WHERE fresh AND rel >= 0.35 GROUP BY ALL),
v AS (SELECT u.*, CASE
    WHEN NOT fresh THEN 'repeat'
    WHEN EXISTS (SELECT 1 FROM st WHERE st.company_id = u.company_id AND st.ch = u.ch) OR EXISTS (SELECT 1 FROM good g WHERE g.company_id = u.company_id AND g.ch = u.ch AND g.at < u.seq) THEN 'known'
    WHEN rel < 0.35 THEN 'rejected' ELSE 'kept' END AS verdict FROM u),
writer AS (SELECT dh, min(seq) AS seq FROM v WHERE verdict = 'kept' AND dh NOT IN (SELECT dh FROM st) GROUP BY dh),
r AS (SELECT seq, company_id, verdict, seq IN (SELECT seq FROM writer) AS inserted, verdict = 'kept' AND NOT EXISTS (SELECT 1 FROM st WHERE st.dh = v.dh AND st.company_id = v.company_id) AS linked FROM v)
"""
_STORE = _STORE_ROWS + "SELECT company_id, count(*) AS seen, count(*) FILTER (inserted) AS inserted, count(*) FILTER (linked) AS linked, count(*) FILTER (verdict = 'rejected') AS rejected FROM r GROUP BY company_id"
_STORE_ROWS += "SELECT * FROM r"


def _market_store(spark, d):
    m = Model(spark, d)
    batch = _batch(m).select("dedupe_hash", "seq")
    stored = spark.range(0, 4000, 3).select(F.concat(F.lit("u"), _C("id").cast("string")).alias("dedupe_hash"), (_C("id") % 2 == 0).alias("is_market_wide"))
    return state.store_market(batch, stored).groupBy("is_market_wide").agg(F.count(F.lit(1)).alias("n"))


def _events(m):
    """Conversations as source events: a turn is a version, some are deletes, some stale, some equal."""
    t = _C("turn")
    return m.table("conversations").select(F.lit("wire").alias("provider_id"), _C("conv_id").cast("string").alias("source_id"), F.when((_C("conv_id") + t) % 6 == 5, "delete").otherwise("upsert").alias("action"), F.concat(F.lit("head "), (_C("conv_id") % 3 + F.floor(t / 2)).cast("string")).alias("headline"), F.when(t % 3 != 2, F.col("text")).alias("body"), F.timestamp_seconds(F.lit(1704067200) + (t * 7 % 5) * 3600).alias("updated_at"), t.alias("seq"))


def _history(spark, d):
    h = state.revisions(_events(Model(spark, d)))
    return h.select("source_id", "revision", "action", "headline", F.coalesce("body", F.lit("")).alias("body"), F.date_format("updated_at", "HH:mm").alias("updated"), "deleted")


def _scrubbed(spark, d):
    h = state.revisions(_events(Model(spark, d)))
    now = state.current(state.purge_bodies(h, ["other"]))
    return now.groupBy("deleted").agg(F.count(F.lit(1)).alias("articles"), F.count("body").alias("bodies"), F.sum("revision").cast("long").alias("revisions"))


def _wrapped(m):
    """Every third article is a wrapper; one in four of these leads to a dead host, others to stories that untouched articles have, or to new ones."""
    n = _C("o_orderkey")
    articles = m.articles.select("id", F.when(_C("id") % 3 == 0, F.concat(F.lit("https://finnhub.io/api/news?id="), _C("id").cast("string"))).when(_C("id") % 31 == 1, F.concat(F.lit("https://site.example.com/s/"), _C("id").cast("string"))).otherwise(_C("url")).alias("url"))
    story = F.concat(F.lit("http://WWW.site.example.com/s/"), (n % 900).cast("string"), F.lit("?utm_source=a"))
    resolved = m.table("orders").filter(n % 3 == 0).select(n.alias("id"), F.when(n % 12 == 0, F.concat(F.lit("https://chartmill.com/x/"), n.cast("string"))).when(n % 15 != 3, story).alias("new_url"))
    return articles, resolved


def _collide(spark, d):
    """Each article that is left with its url, or what became of it, and its companies."""
    m = Model(spark, d)
    articles, resolved = _wrapped(m)
    out = state.merge_colliding(articles, m.links.select("article_id", "company_id"), resolved, staged(spark, "merge-plan"))
    n = F.count(F.lit(1))
    companies = out["links"].groupBy(_C("article_id").alias("id")).agg(n.alias("companies"), F.sum("company_id").cast("long").alias("company_ids"))
    kept = out["articles"].select("id", "url", F.lit("kept").alias("action")).join(companies, "id", "left")
    return kept.unionByName(out["deleted"], allowMissingColumns=True)


_COLLIDE = sql("""WITH a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'https://finnhub.io/api/news?id=' || id WHEN id % 31 = 1 THEN 'https://site.example.com/s/' || id ELSE url END AS url,
  id % 3 = 0 AND (id % 12 = 0 OR id % 15 <> 3) AS done, id % 12 = 0 AS dead, 'http://WWW.site.example.com/s/' || (id % 900) || '?utm_source=a' AS target, id % 900 AS story FROM articles),
owner AS (SELECT id, id AS story FROM a WHERE NOT done AND id % 3 <> 0 AND id % 31 = 1),
t AS (SELECT a.*, coalesce((SELECT o.id FROM owner o WHERE o.story = a.story), min(a.id) OVER (PARTITION BY a.story)) AS survivor FROM a WHERE done AND NOT dead),
fate AS (SELECT a.id, CASE WHEN a.done AND a.dead THEN 'dead' WHEN t.survivor <> a.id THEN 'merged' ELSE 'kept' END AS action, CASE WHEN t.survivor = a.id THEN a.target ELSE a.url END AS url, coalesce(t.survivor, a.id) AS survivor FROM a LEFT JOIN t USING (id)),
lk AS (SELECT survivor AS id, count(DISTINCT company_id) AS companies, CAST(sum(DISTINCT company_id) AS BIGINT) AS company_ids FROM links JOIN fate ON fate.id = article_id WHERE action <> 'dead' GROUP BY survivor)
SELECT id, action, CASE WHEN action = 'kept' THEN url END AS url, CASE WHEN action = 'kept' THEN companies END AS companies, CASE WHEN action = 'kept' THEN company_ids END AS company_ids FROM fate LEFT JOIN lk USING (id)""", "articles", "links")


def _url_cache(spark, d):
    m = Model(spark, d)
    seen = m.articles.select("id", "url", F.concat(F.lit("h"), (_C("id") % 3000).cast("string")).alias("content_hash"))
    batch = m.articles.select(_C("id").alias("article_id"), F.when(_C("id") % 10 == 0, F.lit("https://finnhub.io/n")).otherwise(_C("url")).alias("url"), F.concat(F.lit("h"), (_C("id") % 3000).cast("string")).alias("content_hash"))
    return state.known_urls(batch, seen).select("article_id", "url")


def _old_new(m):
    c = m.companies
    new = c.filter("id % 11 <> 0").select("ticker", F.when(_C("id") % 13 == 0, F.concat("company_name", F.lit(" New"))).otherwise(_C("company_name")).alias("company_name"), "exchange_hint")
    fresh = m.table("nation").select(_C("n_name").alias("ticker"), _C("n_name").alias("company_name"), F.lit(None).cast("string").alias("exchange_hint"))
    return c, new.unionByName(fresh)


def _catalogue_merge(spark, d):
    old, new = _old_new(Model(spark, d))
    return state.catalogue_merge(old, new).select("ticker", "company_name", "resolution_status", "is_active", "change")


def _listing_replace(spark, d):
    m = Model(spark, d)
    old = m.listings.select("company_id", "symbol", F.when(_C("id") % 3 == 0, "catalogue").otherwise("directory").alias("source"), _C("confidence").cast("double").alias("confidence"))
    new = m.listings.select((_C("company_id") * 4).alias("company_id"), F.lower("symbol").alias("symbol"), F.lit("directory").alias("source"), F.lit(0.9).alias("confidence"))
    asked = m.companies.select((_C("id") * 2).alias("company_id"))
    return state.listing_replace(old, new, asked).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_C("source") == "catalogue").alias("asserted"))


def _csv_audit(spark, d):
    """The catalogue written as CSV with repeats, read back and audited."""
    from pressline.sources.sinks import write_csv

    m = Model(spark, d)
    folder = shared_folder(spark, "catalogue")
    n = _C("id")
    rows = m.companies.select(n.alias("line"), "ticker", F.concat(F.lit('Na"me, '), (n % 60 + 100).cast("string")).alias("company_name"), F.lit("").alias("sector"), F.lit("us").alias("country"), F.when(n % 2 == 0, "yes").otherwise("no").alias("is_us_listed"), F.coalesce(F.when(n % 8 == 0, "NOWHERE").otherwise(_C("exchange_hint")), F.lit("")).alias("exchange_hint"))
    again = rows.filter("line % 10 = 5").withColumn("line", _C("line") + 1_000_000)
    write_csv(rows.unionByName(again), folder)
    back = files.read_csv(spark, folder, "line string, ticker string, company_name string, sector string, country string, is_us_listed string, exchange_hint string").withColumn("line", _C("line").cast("long"))
    return files.catalogue_audit(back, "line").groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"))


_AUDIT = sql("""WITH r AS (SELECT id, ticker, id % 60 AS nm, id % 2 = 0 AS us, CASE WHEN id % 8 = 0 THEN 'NOWHERE' ELSE exchange_hint END AS h FROM companies),
i AS (SELECT 'missing_hint' AS issue, ticker AS subject FROM r WHERE h IS NULL UNION ALL SELECT 'unknown_hint', ticker FROM r WHERE h = 'NOWHERE'
  UNION ALL SELECT 'flag_conflict', ticker FROM r WHERE h IS NOT NULL AND h <> 'NOWHERE' AND us <> (h IN ('NYSE', 'OTCPK')) UNION ALL SELECT 'country_conflict', ticker FROM r WHERE h IN ('LSE', 'XTRA', 'TSE', 'SHSE')
  UNION ALL SELECT 'duplicate_ticker', ticker FROM r WHERE id % 10 = 5 UNION ALL SELECT 'duplicate_name', 'na me ' || (nm + 100) FROM r GROUP BY nm HAVING count(*) > 1)
SELECT issue, count(*) AS n, min(subject) AS first FROM i GROUP BY 1""", "companies")


def _duplicate_names(spark, d):
    c = Model(spark, d).companies
    return c.groupBy("name_normalized").agg(F.countDistinct("ticker").alias("tickers"), F.min("ticker").alias("first")).filter("tickers > 1")


def _feed_diff(spark, d):
    """One poll of four feeds: two of them due for a full scan, entries in all states."""
    p = Model(spark, d).table("pages")
    n, feed = _C("page_id"), F.concat(F.lit("f"), (_C("page_id") % 4).cast("string")).alias("feed")
    name = n.cast("string").alias("entry_id")
    entries = p.select(feed, name, F.sha2("html", 256).alias("fingerprint"))
    gone = F.when(n % 3 == 0, F.concat(F.lit("left-"), n.cast("string"))).otherwise(n.cast("string")).alias("entry_id")
    seen = p.select(feed, gone, F.when(n % 3 == 1, F.sha2("html", 256)).otherwise("old").alias("seen_fingerprint"), (n % 5 < 3).alias("imported"), F.when(n % 7 > 2, n % 7 - 2).otherwise(0).cast("int").alias("failures"), (n % 11 == 0).alias("blocked"), (n % 2 == 0).alias("image_checked"))
    scans = p.select(feed).distinct().filter("feed <> 'f0'").withColumn("scanned_at", F.when(_C("feed") == "f1", F.lit("2024-01-01 12:00:00")).otherwise(F.lit("2024-01-01 12:00:01")).cast("timestamp"))
    out = state.fingerprint_diff(entries, seen, scans, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    return out.select(_C("entry_id").cast("long").alias("entry_id"), F.coalesce("why", F.lit("")).alias("why"))


_FEED_DIFF = """SELECT page_id AS entry_id, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 11 = 0 THEN '' WHEN page_id % 3 = 2 THEN 'changed' WHEN page_id % 7 IN (3, 4, 5) THEN 'retry'
  WHEN page_id % 5 < 3 AND page_id % 2 = 1 AND page_id % 7 <= 2 THEN 'image' WHEN page_id % 4 IN (0, 1) THEN 'due' ELSE '' END AS why FROM pages"""


def _rss(spark, d):
    p = Model(spark, d).table("documents")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>&\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    item = F.concat(F.lit("<item><title>"), safe, F.lit("</title><link>https://x.example.com/"), _C("doc_id").cast("string"), F.lit("</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>"))
    # a source has many feed documents of a bounded number of items
    feeds = p.groupBy("source", F.floor(_C("doc_id") / 50)).agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("xml"))
    items = files.rss_items(feeds.select(_C("source").alias("feed"), "xml"), "xml", "feed")
    return items.groupBy("feed").agg(F.count(F.lit(1)).alias("items"), F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"), F.min("url").alias("first_url"))


def _filings(spark, d):
    li = Model(spark, d).table("lineitem")
    acc = F.concat(F.lpad(_C("l_orderkey").cast("string"), 10, "0"), F.lit("-24-"), F.lpad(_C("l_linenumber").cast("string"), 6, "0"))
    form = F.when(_C("l_quantity") % 3 == 0, "8-K").when(_C("l_quantity") % 3 == 1, "10-Q").otherwise("4")
    one = F.struct(acc.alias("a"), form.alias("f"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("x"))
    recent = F.struct(F.transform("x", lambda v: v["a"]).alias("accessionNumber"), F.transform("x", lambda v: v["f"]).alias("form"), F.transform("x", lambda v: v["t"]).alias("acceptanceDateTime"), F.transform("x", lambda v: F.lit("doc.htm")).alias("primaryDocument"))
    subs = g.select(F.lpad(_C("l_orderkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Filer "), _C("l_orderkey").cast("string")).alias("name"), F.struct(recent.alias("recent")).alias("filings"))
    f = files.filings(subs)
    cik, accession = url.filing_parts(_C("url"))
    return f.select("title", cik.alias("cik"), accession.alias("accession"), F.date_format("published_at", "yyyy-MM-dd").alias("day"))


_FILINGS = """SELECT 'Filer ' || l_orderkey || ' — ' || CASE WHEN l_quantity % 3 = 0 THEN '8-K' ELSE '10-Q' END || ' filing' AS title, CAST(l_orderkey AS VARCHAR) AS cik,
  lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(l_linenumber AS VARCHAR), 6, '0') AS accession, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_quantity % 3 <> 2"""


def _market_feed(spark, d):
    e = Model(spark, d).table("events")
    rows = e.select(F.concat(F.lit("u"), (_C("event_id") % 3000).cast("string")).alias("url"), "event_type", F.concat(F.lit(" aa, b"), (_C("event_id") % 5).cast("string"), F.lit(",, ")).alias("related"), "event_id")
    return files.market_news(rows, "event_id").select("url", "event_type", F.array_join("related", "|").alias("related"))


def _stream_dedupe(spark, d):
    """Events delivered twice, through a stream; the second delivery goes."""
    folder = shared_folder(spark, "stream")
    e = Model(spark, d).table("events").select("event_id", _C("ts").cast("timestamp").alias("ts"), "user_id")
    e.unionByName(e.filter("event_id % 4 = 0")).repartition(2).write.parquet(f"{folder}/in")
    stream = jobs.deduplicated(jobs.read_files(spark, f"{folder}/in", "event_id long, ts timestamp, user_id long", 100), "event_id", "ts", "60 days")
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, ts timestamp, user_id long").parquet(f"{folder}/out").select("event_id", "user_id")


def _stream_upsert(spark, d):
    """The revision history from batches of a stream; equal to that of the whole table."""
    folder = shared_folder(spark, "revisions")
    events = _events(Model(spark, d))
    for part in ("seq < 2", "seq >= 2 AND seq < 4", "seq >= 4"):  # events arrive in their order, several files at a time
        events.filter(part).repartition(4, "source_id").write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_files(spark, f"{folder}/in", events.schema, 1)
    jobs.run_revisions(stream, f"{folder}/history", f"{folder}/check")
    h = jobs.read_revisions(spark, f"{folder}/history")
    return h.select("source_id", "revision", "action", "headline", F.coalesce("body", F.lit("")).alias("body"), "deleted")


def _stream_velocity(spark, d):
    folder = shared_folder(spark, "velocity")
    e = Model(spark, d).table("events").select(_C("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(f"{folder}/in")
    stream = jobs.velocity(jobs.read_files(spark, f"{folder}/in", "ts timestamp, event_type string", 10), "event_type", "ts", "7 days", "7 days")
    last = jobs.run_states(stream, f"{folder}/out", f"{folder}/check", ["event_type", "from"])
    return last.select("event_type", F.date_format("from", "yyyy-MM-dd").alias("from_day"), "n")


def _stream_fetch(spark, d):
    """Fetch state from a stateful stream, the last update of each key."""
    folder = shared_folder(spark, "fetches")
    ev = Model(spark, d).run_events.select("company_id", "provider", "seq", "at", _C("outcome").isin("ok", "no_news").alias("ok"))
    ev.repartitionByRange(2, "seq").write.parquet(f"{folder}/in")
    stream = jobs.fetch_states(jobs.read_files(spark, f"{folder}/in", ev.schema, 100))
    t = jobs.run_states(stream, f"{folder}/out", f"{folder}/check", ["company_id", "provider"])
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_success_at", "suppressed_until")}
    return t.select("company_id", "provider", _C("consecutive_failures").cast("long").alias("consecutive_failures"), *(v.alias(k) for k, v in shown.items()))


def _images(spark, d):
    """Pages as releases: their figures stand before the page, in it with its article as the section, or are another's."""
    from pressline.functions import images

    n = _C("page_id")
    date = F.lpad((n % 12 + 1).cast("string"), 2, "0")
    stem = F.concat(F.lit("26"), date, F.lit("07"))
    credit = F.when(n % 5 == 0, "Source: ECB. Photo by Desk").when(n % 5 == 1, "Sources: ECB calculations based on data of the page").otherwise("Source: ECB")
    figure = F.concat(F.lit('<div class="figure"><p class="title">Chart '), n.cast("string"), F.lit('</p><figure><img src="pr'), stem, F.lit("/ecb.pr"), stem, F.lit('.en_img1.png"><figcaption><p>'), credit, F.lit("<br>Note: none.</p></figcaption></figure></div>"))
    section = F.lit('<main><div class="section">')
    own = F.replace(F.replace("html", F.lit("<article>"), section), F.lit("</article>"), F.concat(figure, F.lit("</div></main>")))
    page = F.when(n % 3 == 0, F.concat(section, figure, F.lit("</div></main>"), "html")).when(n % 3 == 1, own).otherwise(F.concat("html", figure))
    address = F.concat(F.lit("https://www.ecb.europa.eu/press/pr/date/2026/html/ecb.pr"), stem, F.lit("~0a.en.html"))
    found = Model(spark, d).table("pages").select("page_id", images.release_image(F.when(n % 7 == 0, "fed").otherwise("ecb"), page, address).alias("f"))
    return found.select("page_id", "f.link", "f.attribution")


_IMAGES = """SELECT page_id, CASE WHEN ok THEN 'https://www.ecb.europa.eu/press/pr/date/2026/html/pr' || stem || '/ecb.pr' || stem || '.en_img1.png' END AS link,
  CASE WHEN ok THEN 'Chart ' || page_id || ' — ' || CASE WHEN page_id % 5 = 1 THEN 'Sources: ECB calculations based on data of the page' ELSE 'Source: ECB' END END AS attribution
FROM (SELECT page_id, '26' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '07' AS stem, page_id % 3 <> 2 AND page_id % 5 <> 0 AND page_id % 7 <> 0 AS ok FROM pages)"""


def _official(spark, d):
    """The article of each page in the layout of one of three sources, and its text where a reader may have it."""
    from pressline.functions import text

    n = _C("page_id")
    kind = F.when(n % 3 == 0, "fed").when(n % 3 == 1, "ecb").otherwise("sec")
    opened = F.when(n % 3 == 0, F.lit('<div id="article"><div class="heading col-sm-8 col-md-8">T</div><div class="col-xs-12 col-sm-8 col-md-8"><div>')).when(n % 3 == 1, '<main><div class="section">').otherwise("<body>")
    closed = F.when(n % 3 == 0, F.lit("</div></div></div>")).when(n % 3 == 1, "</div></main>").otherwise("</body>")
    page = F.replace(F.replace(F.regexp_replace("html", "</?body[^>]*>", ""), F.lit("<article>"), opened), F.lit("</article>"), closed)
    return Model(spark, d).table("pages").select("page_id", text.official_body(kind, page).alias("body"))


_ARTICLE_PLAIN = _PLAIN.replace("FROM pages", "FROM (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS html FROM pages)")

QUERIES = {
    "resolve_hints": (_hints, _hint_oracle()),
    "alias_validity": (_alias_validity, sql("SELECT id AS company_id, 'trade name ' || id AS alias_name FROM companies WHERE id % 9 <> 0 AND id % 40 <= 24 AND id % 40 > 5", "companies")),
    "alias_matches": (_alias_matches, sql("""SELECT c.id AS hint_id, CASE WHEN c.id % 6 = 0 AND EXISTS (SELECT 1 FROM companies o WHERE o.id = c.id + 1 AND o.is_active) THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN NOT (c.id % 6 = 0 AND EXISTS (SELECT 1 FROM companies o WHERE o.id = c.id + 1 AND o.is_active)) THEN c.id END AS company_id
FROM companies c WHERE is_active AND id % 9 <> 0 AND id % 40 <= 24 AND id % 40 > 5""", "companies")),
    "us_symbol_directory": (_us_directory, """SELECT m AS mic, count(*) AS n, CAST(CASE m WHEN 'XNYS' THEN 0 WHEN 'XNAS' THEN 1 WHEN 'ARCX' THEN 2 WHEN 'OOTC' THEN 9 ELSE 8 END AS BIGINT) AS rank, m IN ('XNYS', 'XNAS', 'ARCX') AS listed, count(*) FILTER (WHERE p_type = 'PROMO') AS adrs
FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN 'XNYS' WHEN 1 THEN 'XNAS' WHEN 2 THEN 'OOTC' WHEN 3 THEN 'ARCX' ELSE 'XLON' END AS m FROM part) GROUP BY m"""),
    "resolution_cascade": (_cascade, None),
    "resolution_lines": (_cascade_lines, None),
    "best_by_name_and_quality": (_best, sql("""WITH c AS (SELECT company_id, symbol, 0.5 + (id % 50) / 100.0::DOUBLE AS score, CASE WHEN exchange_code = 'SS' THEN 9 WHEN exchange_code = 'US' THEN 4 ELSE 3 END + CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END + 1 AS quality FROM listings),
t AS (SELECT *, max(score) OVER (PARTITION BY company_id) AS top FROM c WHERE score >= 0.6)
SELECT company_id, symbol, round(score, 6) AS score, CAST(quality AS BIGINT) AS quality FROM t WHERE score > top - 0.05 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY quality DESC, score DESC, symbol) = 1""", "listings")),
    "expand_listings": (_expand, sql("""WITH n AS (SELECT *, id = min(id) OVER (PARTITION BY company_id) AS first FROM listings), p AS (SELECT company_id, exchange_code, symbol, mic, is_us, TRUE AS is_primary, confidence::DOUBLE AS c FROM n WHERE first), cap AS (SELECT company_id, max(c) AS cap FROM p GROUP BY 1),
r AS (SELECT company_id, exchange_code, symbol, mic, is_us, CASE WHEN id % 3 = 0 THEN is_primary ELSE FALSE END AS is_primary, least(confidence::DOUBLE, cap) AS c FROM n JOIN cap USING (company_id) WHERE NOT first),
u AS (SELECT company_id, exchange_code, symbol, min(mic) AS mic, bool_or(is_us) AS is_us, bool_or(is_primary) AS marked, max(c) AS confidence FROM (SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY 1, 2, 3),
h AS (SELECT u.*, CASE exchange_hint WHEN 'NYSE' THEN 'US' WHEN 'LSE' THEN 'LN' WHEN 'XTRA' THEN 'GY' WHEN 'TSE' THEN 'JT' WHEN 'SHSE' THEN 'C1' WHEN 'OTCPK' THEN 'US' END AS hc FROM u LEFT JOIN companies c ON c.id = u.company_id)
SELECT company_id, exchange_code, symbol, is_us, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN marked THEN 0 WHEN exchange_code = hc THEN 1 WHEN is_us AND mic <> 'OOTC' THEN 2 ELSE 3 END, confidence DESC, exchange_code, symbol) = 1 AS is_primary, round(confidence, 6) AS confidence FROM h""", "listings", "companies")),
    "asserted_us_lines": (_asserted, sql("""WITH l AS (SELECT * REPLACE (is_us AND company_id % 14 <> 0 AS is_us) FROM listings), a AS (SELECT id FROM companies WHERE exchange_hint IN ('NYSE', 'OTCPK') AND is_us_listed AND regexp_matches(ticker, '^[A-Z][A-Z0-9]{0,5}$') AND id NOT IN (SELECT company_id FROM l WHERE is_us)),
u AS (SELECT company_id, is_primary AND company_id NOT IN (SELECT id FROM a) AS p, confidence::DOUBLE AS c FROM l UNION ALL SELECT id, TRUE, 0.5 FROM a)
SELECT company_id, count(*) AS n, count(*) FILTER (WHERE p) AS primaries, count(*) FILTER (WHERE c = 0.5) AS asserted_or_half FROM u GROUP BY 1""", "listings", "companies")),
    "symbol_owner": (_symbol_owner, sql("SELECT upper(symbol) AS symbol, min(company_id) AS company_id FROM listings GROUP BY 1", "listings")),
    "us_symbols": (_us_symbols, sql("SELECT company_id, count(DISTINCT upper(symbol)) FILTER (WHERE is_us) AS n, coalesce(min(upper(symbol)) FILTER (WHERE is_us), '') AS first FROM listings GROUP BY 1", "listings")),
    "store_articles": (_store_rows, _STORE_ROWS),
    "store_articles_stats": (_store, _STORE),
    "store_market_news": (_market_store, """WITH st AS (SELECT 'u' || i AS dh, i % 2 = 0 AS w FROM range(0, 4000, 3) t(i)), b AS (SELECT DISTINCT 'u' || (l_orderkey % 4000) AS dh FROM lineitem)
SELECT w AS is_market_wide, count(*) AS n FROM (SELECT w FROM st UNION ALL SELECT TRUE FROM b WHERE dh NOT IN (SELECT dh FROM st)) GROUP BY 1"""),
    "revision_history": (_history, None),
    "tombstone_scrub": (_scrubbed, None),
    "merge_colliding_links": (_collide, _COLLIDE),
    "resolved_url_cache": (_url_cache, sql("""WITH s AS (SELECT id % 3000 AS h, arg_max(url, id) AS known FROM articles GROUP BY 1)
SELECT id AS article_id, CASE WHEN id % 10 = 0 THEN coalesce(known, 'https://finnhub.io/n') ELSE url END AS url FROM articles LEFT JOIN s ON h = id % 3000""", "articles")),
    "catalogue_merge": (_catalogue_merge, sql("""WITH n AS (SELECT ticker, company_name || CASE WHEN id % 13 = 0 THEN ' New' ELSE '' END AS nm, exchange_hint AS h FROM companies WHERE id % 11 <> 0 UNION ALL SELECT n_name, n_name, NULL FROM nation)
SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(nm, company_name) AS company_name, CASE WHEN n.ticker IS NOT NULL AND (o.ticker IS NULL OR nm <> company_name) THEN 'pending' ELSE resolution_status END AS resolution_status, n.ticker IS NOT NULL AS is_active,
  CASE WHEN o.ticker IS NULL THEN 'inserted' WHEN n.ticker IS NULL THEN CASE WHEN o.is_active THEN 'deactivated' ELSE 'unchanged' END WHEN nm <> company_name OR NOT o.is_active THEN 'updated' ELSE 'unchanged' END AS change
FROM companies o FULL JOIN n ON n.ticker = o.ticker""", "companies")),
    "listing_replace": (_listing_replace, sql("""WITH asked AS (SELECT id * 2 AS company_id FROM companies), new AS (SELECT company_id * 4 AS company_id FROM listings WHERE company_id * 4 IN (SELECT company_id FROM asked)), k AS (SELECT company_id, id % 3 = 0 AS cat FROM listings WHERE company_id NOT IN (SELECT company_id FROM asked) OR (company_id NOT IN (SELECT company_id FROM new) AND NOT (id % 3 = 0 AND confidence <= 0.5)))
SELECT company_id, count(*) AS n, count(*) FILTER (WHERE cat) AS asserted FROM (SELECT * FROM k UNION ALL SELECT company_id, FALSE FROM new) GROUP BY 1""", "listings", "companies")),
    "catalogue_audit": (_csv_audit, _AUDIT),
    "duplicate_names": (_duplicate_names, sql("SELECT name_normalized, count(DISTINCT ticker) AS tickers, min(ticker) AS first FROM companies GROUP BY 1 HAVING count(DISTINCT ticker) > 1", "companies")),
    "feed_fingerprint_diff": (_feed_diff, _FEED_DIFF),
    "rss_items": (_rss, "SELECT source AS feed, count(*) AS items, '2024-01-02 03:04:05' AS newest, min('https://x.example.com/' || doc_id) AS first_url FROM documents GROUP BY 1"),
    "filings_columnar": (_filings, _FILINGS),
    "market_feed_dedupe": (_market_feed, "SELECT 'u' || (event_id % 3000) AS url, event_type, 'AA|B' || (event_id % 5) AS related FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY event_id) = 1"),
    "release_images": (_images, _IMAGES),
    "official_bodies": (_official, f"WITH {_ARTICLE_PLAIN} SELECT page_id, CASE WHEN length(trim(t, ' ' || chr(10))) BETWEEN 50 AND 160000 THEN trim(t, ' ' || chr(10)) END AS body FROM t5"),
    "stream_dedupe": (_stream_dedupe, "SELECT event_id, user_id FROM events"),
    "stream_upsert_state": (_stream_upsert, None),
    "stream_velocity": (_stream_velocity, "SELECT event_type, strftime(to_timestamp(floor(epoch(ts) / 604800) * 604800)::TIMESTAMP, '%Y-%m-%d') AS from_day, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_fetch_state": (_stream_fetch, sql("""WITH o AS (SELECT *, outcome IN ('ok', 'no_news') AS ok FROM run_events), l AS (SELECT company_id, provider, coalesce(max(seq) FILTER (WHERE ok), -1) AS last_ok FROM o GROUP BY 1, 2)
SELECT o.company_id, o.provider, count(*) FILTER (WHERE seq > last_ok) AS consecutive_failures, CASE WHEN count(*) FILTER (WHERE seq > last_ok) >= 5 THEN strftime(max(at_ts) FILTER (WHERE seq > last_ok) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') END AS suppressed_until, strftime(max(at_ts) FILTER (WHERE seq = last_ok), '%Y-%m-%d %H:%M:%S') AS last_success_at FROM o JOIN l USING (company_id, provider) GROUP BY 1, 2""", "run_events")),
}
