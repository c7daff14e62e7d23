"""URLs as Column expressions: canonical form, hosts, public-link rules and redaction."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_GROUPS = {"scheme": 1, "userinfo": 2, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}

# Query parameters that never change the article.
TRACKING = (
    "^utm_", "^ic[ni]d$", "^cmpid$", "^ref$", "^ref_?src$", "^src$", "^fbclid$", "^gclid$", "^msclkid$", "^mc_[ce]id$", "^_ga$", "^yptr$", "^guccounter$", "^guce_", "^spm$", "^share", "^__twitter", "^at_(medium|campaign)$", "^cid$", "^partner$", "^smid$", "^ito$",
)
DEAD_HOSTS = ("chartmill.com",)
UNREADABLE_HOSTS = r"(?i)(^|\.)news\.google\.com$"
WRAPPER_HOSTS = r"(?i)(^|\.)finnhub\.io$"
SECRET_PARAMS = r"(?i)^(token|api_?token|api_?key|apikey|key|access_?token|auth|password|secret)$"


def part(url: Column, name: str) -> Column:
    """A part of a URL; empty if it has none, null if the URL can't be parsed."""
    text = F.trim(url)
    return F.when(text.rlike(_PARTS), F.regexp_extract(text, _PARTS, _GROUPS[name]))


def host(url: Column) -> Column:
    """Lower-case host; null if the URL can't be parsed."""
    return F.lower(part(url, "host"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_tracking(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(TRACKING))


def canonical_query(query: Column) -> Column:
    """Parameters without tracking ones, stably sorted by name and form-encoded."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    recode = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    rows = F.transform(pairs, lambda p, i: F.struct(F.coalesce(F.try_url_decode(F.split(p, "=", 2)[0]), F.split(p, "=", 2)[0]).alias("name"), i.alias("i"), recode(F.coalesce(F.get(F.split(p, "=", 2), 1), F.lit(""))).alias("value")))
    kept = F.array_sort(F.filter(rows, lambda r: ~is_tracking(r["name"])))
    return F.array_join(F.transform(kept, lambda r: F.concat(F.url_encode(r["name"]), F.lit("="), r["value"])), "&")


def canonical_path(path: Column) -> Column:
    """One leading AMP mark gone, single slashes, no trailing slash but for the root."""
    p = F.regexp_replace(path, r"(?is)^(.*?)(?:/amp|\.amp)(?:/|$)", "$1/")
    p = F.regexp_replace(F.when(p == "", F.lit("/")).otherwise(p), "/{2,}", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def canonical_url(url: Column) -> Column:
    """https, bare lower-case host (no port or user), no fragment, no tracking; junk is trimmed and lower-cased."""
    query = canonical_query(part(url, "query"))
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.lit("https://"), bare_host(url), canonical_path(part(url, "path")), tail), F.lower(F.trim(url)))


def on_host(where: Column, hosts) -> Column:
    out = F.lit(False)
    for h in hosts:
        out = out | (where == h) | where.endswith("." + h)
    return F.coalesce(out, F.lit(False))


def is_dead_host(url: Column, hosts=DEAD_HOSTS) -> Column:
    """Is the host, or a parent of it, one that serves nobody?  False for null and junk; no hosts disable it."""
    return on_host(bare_host(url), hosts)


def is_wrapper(url: Column) -> Column:
    return F.coalesce(host(url).rlike(WRAPPER_HOSTS), F.lit(False))


def is_readable(url: Column, hosts=DEAD_HOSTS) -> Column:
    h = host(url)
    return h.isNotNull() & ~F.coalesce(h.rlike(UNREADABLE_HOSTS), F.lit(False)) & ~is_dead_host(url, hosts)


def is_article(url: Column, headline: Column, hosts=DEAD_HOSTS) -> Column:
    """Row filter of articles: url and headline not blank, http(s), a host that readers can open."""
    filled = (F.trim(F.coalesce(url, F.lit(""))) != "") & (F.trim(F.coalesce(headline, F.lit(""))) != "")
    return filled & F.coalesce(F.trim(url).rlike("(?i)^https?://"), F.lit(False)) & is_readable(url, hosts)


_NUMERIC_HOST = r"^[0-9.]+$|^\[|^0x"
_PRIVATE = r"(?i)^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)|\.local$|\.internal$|^\["


def safe_public_url(url: Column) -> Column:
    """The URL with scheme and host in lower case if it may be shown: https, at most 4000 characters, no user, a public name as host; else null."""
    h = host(url)
    fine = (F.lower(part(url, "scheme")) == "https") & (F.length(url) <= 4000) & (part(url, "userinfo") == "") & h.contains(".") & ~h.rlike(_NUMERIC_HOST) & (h != "localhost") & ~h.endswith(".local") & ~h.endswith(".localhost")
    rest = F.regexp_extract(F.trim(url), r"(?s)^[^:]*://[^/?#]*(.*)$", 1)
    port = F.when(part(url, "port").isin("", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(url, "port")))
    return F.when(fine, F.concat(F.lit("https://"), h, port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def is_public_link(url: Column) -> Column:
    """http(s), no user, no private host, no query key that looks like a secret."""
    keys = F.transform(F.split(part(url, "query"), "&"), lambda p: F.split(p, "=", 2)[0])
    ok = F.lower(part(url, "scheme")).isin("http", "https") & (part(url, "userinfo") == "") & ~host(url).rlike(_PRIVATE) & ~F.exists(keys, lambda k: k.rlike(SECRET_PARAMS))
    return F.coalesce(ok, F.lit(False))


# Provider, purpose, host, path pattern, and whether a query is allowed.
FETCH_RULES = (
    ("fed", "body", "www.federalreserve.gov", r"^/newsevents/pressreleases/[a-z]+\d{8}[a-z]?\.htm$", False),
    ("fed", "api", "www.federalreserve.gov", r"^/feeds/press_(all|monetary)\.xml$", False),
    ("ecb", "body", "www.ecb.europa.eu", r"(?i)^/press/pr/date/\d{4}/html/ecb\.[a-z0-9~_.-]+\.en\.html$", False),
    ("ecb", "api", "www.ecb.europa.eu", r"^/rss/press\.html$", False),
    ("sec", "body", "www.sec.gov", r"(?i)^/Archives/edgar/data/\d{1,10}/\d{18}/[a-z0-9_.-]+\.(?:htm|html|txt)$", False),
    ("sec", "api", "data.sec.gov", r"^/submissions/CIK\d{10}\.json$", False),
    ("sec", "api", "www.sec.gov", r"^/files/company_tickers_exchange\.json$|^/cgi-bin/browse-edgar$|^/Archives/edgar/data/\d{1,10}/\d{18}/index\.json$", True),
    ("benzinga", "api", "api.benzinga.com", r"^/api/v2/news(?:-removed)?$", True),
    ("marketaux", "api", "api.marketaux.com", r"^/v1/news/all$", True),
    ("finnhub", "api", "finnhub.io", r"^/api/v1/(?:news|company-news)$", True),
)


def allowed(url: Column, provider: Column, purpose: Column, rules=FETCH_RULES) -> Column:
    """Does a rule allow the URL?  https only, no user, port, fragment or encoded separators; a doubled leading slash of ecb is one."""
    path = F.when(provider == "ecb", F.regexp_replace(part(url, "path"), "^/{2,}", "/")).otherwise(part(url, "path"))
    plain = (F.lower(part(url, "scheme")) == "https") & (part(url, "port") == "") & (part(url, "fragment") == "") & (part(url, "userinfo") == "") & ~path.rlike("(?i)%2f|%5c|%2e")
    hit = F.lit(False)
    for who, what, where, pattern, queries in rules:
        one = (provider == who) & (purpose == what) & (host(url) == where) & path.rlike(pattern)
        hit = hit | (one if queries else one & (part(url, "query") == ""))
    return F.coalesce(plain & hit, F.lit(False))


def redact(text: Column, secrets=()) -> Column:
    """Known secrets, then secret query values (of URLs) or key=value pairs (of other text), as REDACTED."""
    out = text
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("REDACTED"))
    names = "token|api_?token|api_?key|apikey|key|access_?token|auth|password|secret"
    in_url = F.regexp_replace(out, rf"(?i)([?&](?:{names})=)[^&#]*", "$1REDACTED")
    in_text = F.regexp_replace(out, rf"""(?i)\b({names})[=:]\s*[^&\s"']+""", "$1=REDACTED")
    return F.when(out.rlike(_PARTS), in_url).otherwise(in_text)


def redact_nested(value: Column, kind: DataType, secrets) -> Column:
    """value (a column of type kind) with known secrets, plain or percent-encoded, replaced in every string in it: fields of structs, elements of arrays, values of maps; keys and all else stay."""
    spelled = [x for s in secrets if s and s.strip() for x in dict.fromkeys((s.strip(), quote(s.strip(), safe="!'()*-._~")))]

    def clean(c: Column, t: DataType) -> Column:
        if isinstance(t, StringType):
            for s in spelled:
                c = F.replace(c, F.lit(s), F.lit("[redacted]"))
            return c
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields)))
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, MapType):
            return F.transform_values(c, lambda _, x: clean(x, t.valueType))
        return c

    return clean(value, kind)


def redacted(df: DataFrame, secrets) -> DataFrame:
    """df with known secrets replaced in all its strings, however deep."""
    return df.select(*(redact_nested(F.col(f"`{f.name}`"), f.dataType, secrets).alias(f.name) for f in df.schema.fields))


def publisher_domain(url: Column) -> Column:
    """What stands between the scheme (and www.) and the first slash."""
    return F.split_part(F.regexp_replace(url, r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1))


RELEASE_IMAGE = r"^https://(www\.federalreserve\.gov|www\.ecb\.europa\.eu)/[^?#]+\.(?:png|jpe?g|webp)$"
ARCHIVE_URL = r"^https://www\.sec\.gov/Archives/edgar/data/(\d+)/(\d{18})/"


def is_release_image(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)" + RELEASE_IMAGE), F.lit(False))


def filing_parts(url: Column) -> tuple[Column, Column]:
    """Company number and accession number (with dashes) of a filing's archive URL."""
    raw = F.regexp_extract(url, ARCHIVE_URL, 2)
    return F.nullif(F.regexp_extract(url, ARCHIVE_URL, 1), F.lit("")), F.nullif(F.regexp_replace(raw, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3"), F.lit(""))
