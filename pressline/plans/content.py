"""URL, text, name, relevance and symbol queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import control, exchange, hashing, names, relevance, text, url
from pressline.operators import resolution
from pressline.plans.model import Model, sql

_C = F.col


def _pages(spark, d):
    return Model(spark, d).table("pages")


def _variants(spark, d):
    """Page URLs with the spellings that canonical form folds."""
    n = _C("page_id")
    dressed = F.when(n % 5 == 0, F.concat(_C("url"), F.when(_C("url").contains("#"), "x").otherwise("?b=2&a=1&UTM_term=z"))).when(n % 5 == 1, F.regexp_replace(_C("url"), "^https?://", "HTTP://user@WWW.")).when(n % 5 == 2, F.concat(F.regexp_replace(_C("url"), "[?#].*$", ""), F.lit("/amp/"))).when(n % 5 == 3, F.concat(F.lit(" not a url "), n.cast("string"))).otherwise(_C("url"))
    return _pages(spark, d).select("page_id", dressed.alias("raw"))


_VARIANTS = """raws AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || CASE WHEN contains(url, '#') THEN 'x' ELSE '?b=2&a=1&UTM_term=z' END WHEN 1 THEN regexp_replace(url, '^https?://', 'HTTP://user@WWW.')
  WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '/amp/' WHEN 3 THEN ' not a url ' || page_id ELSE url END AS raw FROM pages)"""
_TRACK = "|".join(url.TRACKING)
_CANON = f"""parts AS (SELECT page_id, raw, regexp_matches(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?[^/?#:@]+') AS ok,
  regexp_replace(lower(regexp_extract(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\\.', '') AS host,
  regexp_extract(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(trim(raw), '^[^?#]*\\?([^#]*)', 1) AS query FROM raws),
paths AS (SELECT *, regexp_replace(CASE WHEN path0 = '' THEN '/' ELSE regexp_replace(path0, '(?is)^(.*?)(?:/amp|\\.amp)(?:/|$)', '\\1/') END, '/{{2,}}', '/', 'g') AS path1 FROM parts),
qs AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i){_TRACK}')) AS params FROM paths),
canon AS (SELECT page_id, raw, CASE WHEN ok THEN 'https://' || host || CASE WHEN length(path1) > 1 THEN regexp_replace(path1, '/$', '') ELSE path1 END
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(list_transform(params, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') ELSE '' END ELSE lower(trim(raw)) END AS canonical FROM qs)"""


def _canonical(spark, d):
    return _variants(spark, d).select("page_id", url.canonical_url(_C("raw")).alias("canonical"))


def _dedupe(spark, d):
    return _variants(spark, d).select("page_id", hashing.dedupe_hash(url.canonical_url(_C("raw"))).alias("dedupe_hash"))


def _dead(spark, d):
    hosts = ("example.org", "ththre.example.net")
    p = _pages(spark, d)
    return p.select("page_id", url.is_dead_host(_C("url"), hosts).alias("dead"), url.is_wrapper(_C("url")).alias("wrapper"), url.is_readable(_C("url"), hosts).alias("readable"), F.coalesce(url.safe_public_url(_C("url")).isNotNull(), F.lit(False)).alias("public_https"))


def _tracking(spark, d):
    q = _pages(spark, d).select(F.explode(F.split(url.part(_C("url"), "query"), "&")).alias("p")).filter("p <> ''")
    name = F.split(_C("p"), "=")[0]
    return q.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(url.is_tracking(name)).alias("tracking"))


def _redacted(spark, d):
    front = F.substring_index("url", "#", 1)
    raw = F.concat(front, F.when(front.contains("?"), "&").otherwise("?"), F.lit("token=abc&x=1"), F.expr("substring(url, length(substring_index(url, '#', 1)) + 1)"))
    return _pages(spark, d).select("page_id", url.redact(raw).alias("shown"), url.redact(F.concat(F.lit("failed: api_key=q"), _C("page_id").cast("string"))).alias("message"))


def _docs(spark, d):
    return Model(spark, d).table("documents")


def _content_hash(spark, d):
    when = F.timestamp_seconds(F.lit(1704067200) + _C("doc_id") % 3 * 86400)
    return _docs(spark, d).select("doc_id", hashing.content_hash(F.substring_index("text", "\n", 1), when).alias("content_hash"))


def _syndicated(spark, d):
    h = _docs(spark, d).select("doc_id", text.normalize_headline(F.substring_index("text", "\n", 1)).alias("headline"))
    return h.groupBy("headline").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def _exact_headline(spark, d):
    return _docs(spark, d).select("doc_id", text.exact_headline(F.substring_index("text", "\n", 1)).alias("headline"))


def _plain(spark, d):
    return _pages(spark, d).select("page_id", text.plain_text(_C("html")).alias("text"))


_PLAIN = """t1 AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
t2 AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<svg\\b[^>]*>.*?</svg\\s*>|<iframe\\b[^>]*>.*?</iframe\\s*>|<form\\b[^>]*>.*?</form\\s*>', ' ', 'g'), '(?is)<(script|style)\\b[^>]*>.*$', ' ') AS t FROM t1),
t3 AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|h[1-6]|li|tr|br|section|article|blockquote)\\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM t2),
t4 AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&lt;', '<'), '&amp;', '&') AS t FROM t3),
t5 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\t\\r ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM t4)"""


def _preview(spark, d):
    """As in the SQL, what has no words (empty or null) is read in a minute too."""
    return _docs(spark, d).select("doc_id", text.preview_text(_C("text")).alias("preview"), F.coalesce(text.reading_minutes(_C("text")), F.lit(1)).cast("long").alias("minutes"))


def _titles(spark, d):
    t = F.concat(F.substring_index("text", "\n", 1), F.when(_C("doc_id") % 2 == 0, F.concat(F.lit(" - "), _C("source"))).otherwise(""))
    return _docs(spark, d).select("doc_id", text.title_source(t).alias("publisher"), text.title_without_source(t).alias("headline"))


def _topics(spark, d):
    t = F.concat(F.when(_C("doc_id") % 4 == 0, "Revenue and inflation: ").when(_C("doc_id") % 4 == 1, "Regulator acts: ").otherwise(""), _C("text"))
    return _docs(spark, d).select("doc_id", F.array_join(text.topics(t), ",").alias("topics"), text.official_topic(t).alias("official"))


_FORMS = ["Co", "Corp.", "Holdings plc", "Intl Group Ltd", "A/S", "(The) & Sons N.V.", "AG -SPON ADR", "Tech Inc L"]


def _companies(spark, d):
    form = F.element_at(F.array(*(F.lit(f) for f in _FORMS)), (_C("p_partkey") % len(_FORMS) + 1).cast("int"))
    return Model(spark, d).table("part").select(_C("p_partkey").alias("id"), F.concat(F.initcap("p_name"), F.lit(" "), form).alias("name"))


_FORM_SQL = "[" + ", ".join(f"'{f}'" for f in _FORMS) + "]"
_NAMES = f"""named AS (SELECT p_partkey AS id, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' ' || ({_FORM_SQL})[CAST(p_partkey % {len(_FORMS)} + 1 AS INTEGER)] AS name FROM part)"""
_ABBR = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.ABBREVIATIONS.items()) + " ELSE w END"
_NOISE = ", ".join(f"'{w}'" for w in sorted(set(names.NOISE)))
_NORMAL = f"""toks AS (SELECT id, name, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(lower(name), '&', ''), '\\.(com|net|org|io|ai|co)\\b', '', 'g'), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: {_ABBR}), lambda w: w <> '' AND w NOT IN ({_NOISE})) AS t FROM named),
normal AS (SELECT id, name, array_to_string(CASE WHEN len(t) > 1 AND length(t[-1]) = 1 THEN t[:-2] ELSE t END, ' ') AS key FROM toks)"""


def _normalize(spark, d):
    return _companies(spark, d).select("id", names.normalize_name(_C("name")).alias("key"))


def _distinct_names(spark, d):
    return _companies(spark, d).groupBy("name").agg(F.min("id").alias("id"))


def _similar(spark, d):
    c = _distinct_names(spark, d)
    return resolution.similar(c.select(_C("id").alias("lid"), _C("name").alias("lname")), c.select(_C("id").alias("rid"), _C("name").alias("rname"))).select("lid", "rid", F.round("similarity", 9).alias("similarity"))


_SIMILAR = f"""WITH {_NAMES}, {_NORMAL},
u AS (SELECT min(id) AS id, key, name FROM normal GROUP BY key, name), n AS (SELECT id, key, string_split(key, ' ') AS t FROM u),
p AS (SELECT a.id AS lid, b.id AS rid, a.key AS ka, b.key AS kb, len(list_distinct(a.t)) AS na, len(list_distinct(b.t)) AS nb, CASE WHEN len(a.t) <= len(b.t) THEN a.t ELSE b.t END AS s, CASE WHEN len(a.t) <= len(b.t) THEN b.t ELSE a.t END AS l FROM n a, n b),
h AS (SELECT *, list_sum(list_transform(list_distinct(s), lambda w: CASE WHEN list_contains(l, w) THEN 1.0::DOUBLE WHEN length(w) < 3 OR len(s) < 2 THEN 0.0
  WHEN w = s[-1] THEN CASE WHEN len(list_filter(l, lambda o: length(o) >= 3 AND (starts_with(o, w) OR starts_with(w, o)))) > 0 THEN 0.85 ELSE 0.0 END
  WHEN len(s) >= 3 AND length(w) >= 4 AND len(list_filter(l, lambda o: length(o) >= 4 AND (starts_with(o, w) OR starts_with(w, o)))) > 0 THEN 0.85 ELSE 0.0 END)) AS sh FROM p),
g AS (SELECT *, sh / least(na, nb) * 0.75::DOUBLE + sh / (na + nb - sh) * 0.25::DOUBLE AS sc FROM h),
r AS (SELECT lid, rid, CASE WHEN ka = '' OR kb = '' THEN 0.0 WHEN replace(ka, ' ', '') = replace(kb, ' ', '') THEN 1.0 WHEN sh = 0 THEN 0.0 WHEN sh = least(na, nb) AND least(na, nb) >= 2 THEN least(1.0, greatest(sc, 0.75))
  WHEN sh <= 1 AND (na > 1 OR nb > 1) THEN least(sc, 0.59) ELSE least(1.0, sc) END AS s FROM g)
SELECT lid, rid, round(CAST(s AS DOUBLE), 9) AS similarity FROM r WHERE s >= 0.6"""


def _shared(spark, d):
    c = _companies(spark, d)
    other = c.select((_C("id") - 1).alias("id"), _C("name").alias("next"))
    return c.join(other, "id").select("id", names.shared_tokens(_C("name"), _C("next")).cast("long").alias("shared"))


def _searchable(spark, d):
    return _companies(spark, d).select("id", names.searchable_name(_C("name")).alias("search_name"), names.home_country(_C("name")).alias("country"), names.issuer_key(_C("name")).alias("issuer"))


_SEARCH = f"""SELECT id, coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '|', ' '), '[\\s,]+'), lambda w: regexp_replace(w, '[^A-Za-z0-9&.\\-'']', '', 'g')), lambda w: w <> '' AND replace(lower(w), '.', '') NOT IN ({_NOISE})), ' '), ''), trim(name)) AS search_name,
  CASE WHEN regexp_matches(name, '(?i)\\bab\\b|\\bpubl\\b') THEN 'SE' WHEN regexp_matches(name, '(?i)\\ba/s\\b|\\baps\\b') THEN 'DK' WHEN regexp_matches(name, '(?i)\\bnv\\b|\\bn\\.v\\b|\\bbv\\b') THEN 'NL' WHEN regexp_matches(name, '(?i)\\bag\\b|\\bgmbh\\b') THEN 'DE' WHEN regexp_matches(name, '(?i)\\bplc\\b') THEN 'GB' END AS country,
  trim(regexp_replace(trim(regexp_replace(replace(lower(name), 'n.v.', 'nv'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '\\s+(?:incorporated|inc|corporation|corp|plc|limited|ltd)$', '')) AS issuer FROM named"""


def _tickers(spark, d):
    return Model(spark, d).companies.select("id", F.array_join(names.ticker_variants(_C("ticker")), ",").alias("variants"))


_SOURCES = ["Reuters", "Yahoo Finance", "The Economist", "Reuters Events", "Globe Newswire", "Local Blog", "FT", "barron's"]


def _source(spark, d):
    s = F.element_at(F.array(*(F.lit(x) for x in _SOURCES)), (_C("doc_id") % len(_SOURCES) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", s.alias("src"), "text", "lang")


_SRC = "([" + ", ".join("'" + s.replace("'", "''") + "'" for s in _SOURCES) + f"])[CAST(doc_id % {len(_SOURCES)} + 1 AS INTEGER)]"
_TIER = " ".join(f"WHEN regexp_matches({{0}}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {t}" for t, p in relevance.TIERS)


def _tier(spark, d):
    return _source(spark, d).select("doc_id", relevance.source_tier(_C("src")).alias("tier"), relevance.backfilled_tier(_C("src"), F.lit(3)).alias("stored_tier"))


def _stories(spark, d):
    """Documents as stories about a company whose name is taken from parts, some of them naming it."""
    name = F.concat(F.element_at(F.array(F.lit("Red Widget Corp"), F.lit("Orange plc"), F.lit("3M Co"), F.lit("Holding AG")), (_C("doc_id") % 4 + 1).cast("int")))
    lead = F.when(_C("doc_id") % 3 == 0, "Orange earnings: red 3m ").when(_C("doc_id") % 3 == 1, "A widget in Red and orange, ").otherwise("")
    return _source(spark, d).select("doc_id", name.alias("company"), F.concat(lead, F.substring_index("text", "\n", 1)).alias("headline"), "src", F.when(_C("doc_id") % 5 == 0, "ticker").otherwise("name_match").alias("method"))


_STORIES = f"""stories AS (SELECT doc_id, (['Red Widget Corp', 'Orange plc', '3M Co', 'Holding AG'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS company, (['red,widget', 'orange', '3m', ''])[CAST(doc_id % 4 + 1 AS INTEGER)] AS tk,
  CASE doc_id % 3 WHEN 0 THEN 'Orange earnings: red 3m ' WHEN 1 THEN 'A widget in Red and orange, ' ELSE '' END || split_part(text, chr(10), 1) AS headline, {_SRC} AS src, CASE WHEN doc_id % 5 = 0 THEN 'ticker' ELSE 'name_match' END AS method FROM documents),
w AS (SELECT *, list_filter(string_split(tk, ','), lambda t: t <> '') AS toks, regexp_split_to_array(lower(headline || ' '), '[^a-z0-9_]+') AS ws, regexp_matches(headline || ' ', '(?i){relevance.FINANCE}') AS biz FROM stories),
v AS (SELECT *, len(toks) AS n, len(list_filter(toks, lambda t: list_contains(ws, t))) AS p FROM w),
x AS (SELECT *, CASE WHEN n >= 2 THEN p >= 2 ELSE n = 1 AND p > 0 AND biz END AS ok, CASE WHEN n = 0 THEN 'company name has no distinctive tokens' WHEN n >= 2 AND p >= 2 THEN 'matched ' || p || '/' || n || ' name tokens' WHEN n >= 2 THEN 'only ' || p || '/' || n || ' name tokens present'
  WHEN p = 0 THEN 'name "' || tk || '" not mentioned' WHEN NOT biz THEN 'single-word name "' || tk || '" with no financial context in the article' ELSE CASE WHEN tk = 'orange' OR length(tk) <= 2 THEN 'short or ambiguous' ELSE 'distinctive' END || ' name "' || tk || '" with financial context' END AS reason FROM v)"""


def _verify(spark, d):
    ok, why = relevance.verify_name(_C("company"), _C("headline"), F.lit(None).cast("string"))
    return _stories(spark, d).select("doc_id", ok.alias("verified"), why.alias("reason"))


def _scores(spark, d):
    value, why, ok = relevance.score(_C("method"), _C("company"), _C("headline"), F.lit(None).cast("string"), _C("src"))
    return _stories(spark, d).select("doc_id", value.cast("double").alias("relevance"), why.alias("reason"), (value >= relevance.FLOOR).alias("kept"))


_SCORES = f"""WITH {_STORIES},
t AS (SELECT *, CASE {_TIER.format('src')} ELSE 3 END AS tier FROM x)
SELECT doc_id, CASE WHEN method = 'ticker' OR ok THEN round(CASE WHEN method = 'ticker' THEN 0.9 ELSE 0.6 END + CASE tier WHEN 1 THEN 0.1 WHEN 3 THEN -0.05 ELSE 0 END, 2)::DOUBLE ELSE 0.0::DOUBLE END AS relevance,
  CASE WHEN method = 'ticker' OR ok THEN CASE WHEN method = 'ticker' THEN 'ticker-native' ELSE reason END || CASE tier WHEN 1 THEN '; primary source' WHEN 3 THEN '; aggregator' ELSE '' END ELSE reason END AS reason,
  (method = 'ticker' OR ok) AS kept FROM t"""


def _mentions(spark, d):
    s = _stories(spark, d).select(_C("doc_id").alias("story_id"), _C("headline").alias("text"))
    who = spark.createDataFrame([(1, "Red Widget Corp"), (2, "Orange plc"), (3, "Of The Sea Ltd"), (4, "Widget In Inc")], "id long, company_name string")
    return resolution.story_mentions(s, who)


def _symbols(spark, d):
    ls = Model(spark, d).listings.select("id", "exchange_code", F.when(_C("id") % 5 == 0, F.concat(_C("symbol"), F.lit("/"))).when(_C("id") % 5 == 1, F.lit("0AB1")).when(_C("id") % 5 == 2, F.lit("CLASB")).otherwise(_C("symbol")).alias("sym"))
    return ls.select("id", exchange.market_symbol(_C("exchange_code"), _C("sym")).alias("market_symbol"), exchange.symbol_format(_C("exchange_code"), _C("sym")).alias("format"))


def _best_listing(spark, d):
    return resolution.fetch_listing(Model(spark, d).listings).select("company_id", "symbol", "silence_counts")


def _top3(spark, d):
    return resolution.top_symbols(Model(spark, d).listings)


def _hints(spark, d):
    c = Model(spark, d).companies
    h = _C("exchange_hint")
    return c.select("id", exchange.hint_field(h, "code").alias("code"), exchange.hint_field(h, "mic").alias("mic"), F.array_join(exchange.candidate_codes(h), ",").alias("codes"), exchange.exchange_key(h).alias("venue_key"), exchange.locale(_C("country"), 2).alias("edition"))


def _statuses(spark, d):
    s = Model(spark, d).table("part").select((_C("p_size") * 13 % 7 * 100 + _C("p_size") % 30).cast("int").alias("status"))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", "n", exchange.http_outcome(_C("status")).alias("outcome"), exchange.is_retryable(_C("status")).alias("retry"))


def _cron(spark, d):
    e = Model(spark, d).table("events").select("event_id", _C("ts").cast("timestamp").alias("ts"))
    return e.filter(control.cron_column("*/15 6-9 1,15 1 *", _C("ts"))).select("event_id")


QUERIES = {
    "canonical_urls": (_canonical, f"WITH {_VARIANTS}, {_CANON} SELECT page_id, canonical FROM canon"),
    "url_dedupe_hash": (_dedupe, f"WITH {_VARIANTS}, {_CANON} SELECT page_id, substr(sha256('url:' || canonical), 1, 40) AS dedupe_hash FROM canon"),
    "dead_or_wrapper_links": (_dead, """WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages), d AS (SELECT *, (regexp_replace(h, '^www\\.', '') IN ('example.org', 'ththre.example.net') OR ends_with(h, '.example.org') OR ends_with(h, '.ththre.example.net')) AS dead FROM h)
SELECT page_id, dead, FALSE AS wrapper, NOT dead AS readable, starts_with(url, 'https:') AS public_https FROM d"""),
    "tracking_param_report": (_tracking, f"""WITH q AS (SELECT unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) SELECT split_part(p, '=', 1) AS name, count(*) AS n, bool_or(regexp_matches(split_part(p, '=', 1), '(?i){_TRACK}')) AS tracking FROM q WHERE p <> '' GROUP BY 1"""),
    "redacted_urls": (_redacted, "SELECT page_id, f || CASE WHEN contains(f, '?') THEN '&' ELSE '?' END || 'token=REDACTED&x=1' || substr(url, length(f) + 1) AS shown, 'failed: api_key=REDACTED' AS message FROM (SELECT *, split_part(url, '#', 1) AS f FROM pages)"),
    "headline_content_hash": (_content_hash, r"""SELECT doc_id, substr(sha256('content:' || trim(regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[‘’“”]', '''', 'g'), '[^\p{L}\p{N}'']+', ' ', 'g')) || ':2024-01-0' || (1 + doc_id % 3)), 1, 40) AS content_hash FROM documents"""),
    "syndicated_duplicates": (_syndicated, r"""SELECT trim(regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[‘’“”]', '''', 'g'), '[^\p{L}\p{N}'']+', ' ', 'g')) AS headline, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"""),
    "headline_full_decomposition": (_exact_headline, r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[‘’“”]', '''', 'g'), '[^\p{L}\p{N}'']+', ' ', 'g')) AS headline FROM documents"""),
    "html_plain_text": (_plain, f"WITH {_PLAIN} SELECT page_id, trim(t, ' ' || chr(10)) AS text FROM t5"),
    "preview_and_reading_time": (_preview, r"""WITH p AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT *, CASE WHEN contains(substr(t, 1, 700), ' ') THEN length(substr(t, 1, 700)) - strpos(reverse(substr(t, 1, 700)), ' ') ELSE -1 END AS sp FROM p)
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 700 THEN t ELSE rtrim(substr(t, 1, CASE WHEN sp > 500 THEN sp ELSE 699 END)) || '…' END AS preview, greatest(1, CAST(ceil(len(string_split(t, ' ')) / 200.0) AS BIGINT)) AS minutes FROM q"""),
    "title_publishers": (_titles, r"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN ' - ' || source ELSE '' END AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '\s+-\s+([^-]{2,40})$', 1), '') AS publisher, trim(regexp_replace(t, '\s+-\s+([^-]{2,40})$', '')) AS headline FROM t"""),
    "topic_tags": (_topics, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'earnings,inflation' WHEN 1 THEN 'regulation' ELSE 'markets' END AS topics, CASE WHEN doc_id % 4 = 0 THEN 'inflation' ELSE 'regulation' END AS official FROM documents"),
    "name_normalize": (_normalize, f"WITH {_NAMES}, {_NORMAL} SELECT id, key FROM normal"),
    "name_similarity_pairs": (_similar, _SIMILAR),
    "shared_tokens": (_shared, f"WITH {_NAMES}, {_NORMAL} SELECT a.id, len(list_intersect(list_filter(string_split(a.key, ' '), lambda t: t <> ''), list_filter(string_split(b.key, ' '), lambda t: t <> ''))) AS shared FROM normal a JOIN normal b ON b.id = a.id + 1"),
    "searchable_names": (_searchable, f"WITH {_NAMES} {_SEARCH}"),
    "ticker_spellings": (_tickers, sql("SELECT id, CASE WHEN contains(upper(ticker), '_') THEN upper(ticker) || ',' || replace(upper(ticker), '_', '.') WHEN contains(ticker, '.') THEN upper(ticker) || ',' || replace(upper(ticker), '.', '_') ELSE upper(ticker) END AS variants FROM companies", "companies")),
    "source_tier": (_tier, f"SELECT doc_id, CASE {_TIER.format(_SRC)} ELSE 3 END AS tier, CASE WHEN regexp_matches({_SRC}, '(?i){relevance.BACKFILL[0][1]}') THEN 1 WHEN regexp_matches({_SRC}, '(?i){relevance.BACKFILL[1][1].replace(chr(39), chr(39) * 2)}') THEN 2 ELSE 3 END AS stored_tier FROM documents"),
    "verify_name_match": (_verify, f"WITH {_STORIES} SELECT doc_id, ok AS verified, reason FROM x"),
    "relevance_scores": (_scores, _SCORES),
    "market_story_mentions": (_mentions, f"""WITH {_STORIES}, f AS (SELECT doc_id AS story_id, ' ' || regexp_replace(lower(strip_accents(headline)), '[^a-z0-9]+', ' ', 'g') || ' ' AS f, headline AS h, biz FROM x)
SELECT story_id, CAST(1 AS BIGINT) AS company_id FROM f WHERE contains(f, ' red widget ') UNION ALL SELECT story_id, 4 FROM f WHERE contains(f, ' widget in ') UNION ALL SELECT story_id, 2 FROM f WHERE contains(f, ' orange ') AND biz AND regexp_matches(h, '(^|[^A-Za-z])Orange\\b')"""),
    "market_symbols": (_symbols, sql("""WITH s AS (SELECT id, exchange_code AS e, CASE id % 5 WHEN 0 THEN symbol || '/' WHEN 1 THEN '0AB1' WHEN 2 THEN 'CLASB' ELSE symbol END AS s FROM listings),
b AS (SELECT *, CASE WHEN e = 'SS' AND s = 'CLASB' THEN 'CLAS-B' ELSE replace(s, '/', '') END AS b, CASE e WHEN 'LN' THEN '.L' WHEN 'GY' THEN '.DE' WHEN 'SS' THEN '.ST' WHEN 'HK' THEN '.HK' ELSE '' END AS x FROM s)
SELECT id, CASE WHEN x <> '' AND NOT (e = 'LN' AND s = '0AB1') THEN b || x END AS market_symbol, CASE WHEN e = 'US' THEN 'us' WHEN regexp_matches(s, '^[0-9]') THEN 'numeric_suffixed' ELSE 'suffixed' END AS format FROM b""", "listings")),
    "best_listing_per_company": (_best_listing, sql("""SELECT company_id, symbol, mic <> 'OOTC' AS silence_counts FROM listings WHERE is_us QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY
  (CASE WHEN mic <> 'OOTC' THEN 100 ELSE 0 END + CASE security_kind WHEN 'adr' THEN 30 WHEN 'ordinary' THEN 20 ELSE 0 END + CASE WHEN is_primary THEN 10 ELSE 0 END + confidence::DOUBLE * 10) DESC, id) = 1""", "listings")),
    "top3_symbols": (_top3, sql("""WITH q AS (SELECT company_id, id, CASE WHEN is_us THEN symbol ELSE symbol || CASE exchange_code WHEN 'LN' THEN '.L' WHEN 'GY' THEN '.DE' WHEN 'SS' THEN '.ST' ELSE '.HK' END END AS query,
  CASE WHEN mic <> 'OOTC' THEN 100 ELSE 0 END + CASE WHEN is_primary THEN 40 ELSE 0 END + CASE security_kind WHEN 'ordinary' THEN 20 WHEN 'adr' THEN 15 ELSE 0 END + confidence::DOUBLE * 10 AS pts FROM listings),
r AS (SELECT company_id, query, CAST(row_number() OVER (PARTITION BY company_id ORDER BY pts DESC, id) AS INTEGER) AS place FROM q) SELECT * FROM r WHERE place <= 3""", "listings")),
    "exchange_hints": (_hints, sql("""SELECT id, CASE exchange_hint WHEN 'NYSE' THEN 'US' WHEN 'LSE' THEN 'LN' WHEN 'XTRA' THEN 'GY' WHEN 'TSE' THEN 'JT' WHEN 'SHSE' THEN 'C1' WHEN 'OTCPK' THEN 'US' END AS code, CASE exchange_hint WHEN 'NYSE' THEN 'XNYS' WHEN 'LSE' THEN 'XLON' WHEN 'XTRA' THEN 'XETR' WHEN 'TSE' THEN 'XTKS' WHEN 'SHSE' THEN 'XSHG' WHEN 'OTCPK' THEN 'OOTC' END AS mic,
  CASE exchange_hint WHEN 'NYSE' THEN 'US' WHEN 'LSE' THEN 'LN' WHEN 'XTRA' THEN 'GY,GR' WHEN 'TSE' THEN 'JT,CN' WHEN 'SHSE' THEN 'C1' WHEN 'OTCPK' THEN 'US' ELSE '' END AS codes, CASE exchange_hint WHEN 'NYSE' THEN 'XNYS' WHEN 'LSE' THEN 'XLON' ELSE coalesce(exchange_hint, '') END AS venue_key, 'US:en' AS edition FROM companies""", "companies")),
    "http_outcomes": (_statuses, """WITH s AS (SELECT CAST(p_size * 13 % 7 * 100 + p_size % 30 AS INTEGER) AS status FROM part) SELECT status, count(*) AS n, CASE WHEN status IN (401, 403) THEN 'refused' WHEN status IN (402, 429) THEN 'rate_limited' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS outcome, status = 429 OR status >= 500 AS retry FROM s GROUP BY 1"""),
    "cron_matches": (_cron, "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 6 AND 9 AND day(ts) IN (1, 15) AND month(ts) = 1"),
}
