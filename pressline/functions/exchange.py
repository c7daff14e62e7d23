"""Venues and symbols as Column expressions over a fixed reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hint, code, alternates, MIC, symbol suffix, country, currency, label; in the order that decides ties.
FIELDS = ("hint", "code", "alternates", "mic", "suffix", "country", "currency", "label")
ROWS = (
    ("NYSE", "US", "", "XNYS", "", "US", "USD", "New York Stock Exchange"),
    ("NASDAQGS", "US", "", "XNAS", "", "US", "USD", "Nasdaq Global Select"),
    ("NASDAQGM", "US", "", "XNAS", "", "US", "USD", "Nasdaq Global Market"),
    ("NASDAQCM", "US", "", "XNAS", "", "US", "USD", "Nasdaq Capital Market"),
    ("XNAS", "US", "", "XNAS", "", "US", "USD", "Nasdaq"),
    ("NYSEAM", "US", "", "XASE", "", "US", "USD", "NYSE American"),
    ("OTCPK", "US", "", "OOTC", "", "US", "USD", "OTC Pink"),
    ("LSE", "LN", "", "XLON", ".L", "GB", "GBP", "London Stock Exchange"),
    ("SWX", "SW", "", "XSWX", ".SW", "CH", "CHF", "SIX Swiss Exchange"),
    ("DB", "GR", "GY", "XETR", ".DE", "DE", "EUR", "Deutsche Boerse"),
    ("XTRA", "GY", "GR", "XETR", ".DE", "DE", "EUR", "Xetra"),
    ("ENXTPA", "FP", "", "XPAR", ".PA", "FR", "EUR", "Euronext Paris"),
    ("ENXTBR", "BB", "", "XBRU", ".BR", "BE", "EUR", "Euronext Brussels"),
    ("BIT", "IM", "", "MTAA", ".MI", "IT", "EUR", "Borsa Italiana"),
    ("WBAG", "AV", "", "XWBO", ".VI", "AT", "EUR", "Wiener Borse"),
    ("BME", "SM", "", "XMAD", ".MC", "ES", "EUR", "Bolsa de Madrid"),
    ("ENXTAM", "NA", "", "XAMS", ".AS", "NL", "EUR", "Euronext Amsterdam"),
    ("ISE", "ID", "", "XDUB", ".IR", "IE", "EUR", "Euronext Dublin"),
    ("ENXTLS", "PL", "", "XLIS", ".LS", "PT", "EUR", "Euronext Lisbon"),
    ("SHSE", "CH", "", "XSHG", ".SS", "CN", "CNY", "Shanghai Stock Exchange"),
    ("SZSE", "CS", "", "XSHE", ".SZ", "CN", "CNY", "Shenzhen Stock Exchange"),
    ("OM", "SS", "", "XSTO", ".ST", "SE", "SEK", "Nasdaq Stockholm"),
    ("CPSE", "DC", "", "XCSE", ".CO", "DK", "DKK", "Nasdaq Copenhagen"),
    ("OB", "NO", "", "XOSL", ".OL", "NO", "NOK", "Oslo Bors"),
    ("HLSE", "FH", "", "XHEL", ".HE", "FI", "EUR", "Nasdaq Helsinki"),
    ("ATSE", "GA", "", "XATH", ".AT", "GR", "EUR", "Athens Exchange"),
    ("BATS-CHIXE", "EB", "", "BATE", "", "GB", "EUR", "Cboe Europe"),
    ("SEHK", "HK", "", "XHKG", ".HK", "HK", "HKD", "Hong Kong Stock Exchange"),
    ("TSE", "JT", "CN", "XTKS", ".T", "JP", "JPY", "Tokyo Stock Exchange"),
    ("SHSE", "C1", "", "XSHG", ".SS", "CN", "CNY", "Shanghai Stock Exchange"),
    ("SZSE", "C2", "", "XSHE", ".SZ", "CN", "CNY", "Shenzhen Stock Exchange"),
    ("NSEI", "IS", "IN", "XNSE", ".NS", "IN", "INR", "National Stock Exchange of India"),
    ("IDX", "IJ", "", "XIDX", ".JK", "ID", "IDR", "Indonesia Stock Exchange"),
    ("TSX", "CN", "CT", "XTSE", ".TO", "CA", "CAD", "Toronto Stock Exchange"),
    ("TSXV", "CV", "", "XTSX", ".V", "CA", "CAD", "TSX Venture Exchange"),
    ("BMV", "MM", "", "XMEX", ".MX", "MX", "MXN", "Bolsa Mexicana de Valores"),
)
REFERENCES = [dict(zip(FIELDS, row, strict=True)) for row in ROWS]
BY_HINT = {r["hint"]: r for r in REFERENCES}  # the last row of a hint counts
BY_CODE = {r["code"]: r for r in reversed(REFERENCES)}  # the first row of a code counts
# Venue codes that roll up to the US.
US_CODES = ("US", "UN", "UW", "UQ", "UR", "UA", "UB", "UC", "UD", "UF", "UM", "UP", "UT", "UV", "UX", "PQ", "VJ", "VK", "VY")
NORDIC = ("SS", "DC", "NO", "FH")
VENUE_RANK = {"XNYS": 0, "XNAS": 1, "ARCX": 2, "BATS": 3, "XASE": 4, "OOTC": 9}
OTHER_VENUE = 8
EXCHANGE_KEYS = {"NASDAQ": "XNAS", "NASDAQGS": "XNAS", "NASDAQGM": "XNAS", "NASDAQCM": "XNAS", "NASD": "XNAS", "NYSE": "XNYS", "AMEX": "XASE", "NYSEAMERICAN": "XASE", "OTC": "OOTC", "LSE": "XLON"}
# Language of the local news edition of a country; editions of Chinese name their script.
LANGUAGES = {
    "DE": "de", "CH": "de", "AT": "de", "FR": "fr", "BE": "fr", "IT": "it", "ES": "es", "MX": "es", "NL": "nl",
    "SE": "sv", "NO": "no", "DK": "da", "FI": "fi", "GR": "el", "JP": "ja", "CN": "zh-CN", "HK": "zh-HK",
    "TW": "zh-TW", "IN": "en", "ID": "id", "GB": "en", "IE": "en", "CA": "en", "AU": "en", "SG": "en", "IL": "he",
    "KZ": "ru", "US": "en",
}
SCRIPTS = {"CN": "zh-Hans", "HK": "zh-Hant", "TW": "zh-Hant"}
LOCALES = {c: (lang, c, f"{c}:{SCRIPTS.get(c, lang)}") for c, lang in LANGUAGES.items()}


def lookup(key: Column, table: dict) -> Column:
    """Value of a small literal table; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def references(spark: SparkSession) -> DataFrame:
    """The reference rows with their place in the table; small enough to be broadcast by size."""
    rows = [(i, *(r[f] for f in FIELDS), r["country"] == "US") for i, r in enumerate(REFERENCES)]
    return spark.createDataFrame(rows, "place int, hint string, code string, alternates string, mic string, suffix string, country string, currency string, label string, is_us boolean")


def _up(x: Column) -> Column:
    return F.upper(F.trim(x))


def hint_field(hint: Column, field: str) -> Column:
    return lookup(_up(hint), {k: r[field] for k, r in BY_HINT.items()})


def code_field(code: Column, field: str) -> Column:
    return lookup(_up(code), {k: r[field] for k, r in BY_CODE.items()})


def candidate_codes(hint: Column) -> Column:
    """Codes to try for a hint, the primary one first; empty for unknown hints."""
    found = F.split(F.concat_ws("|", hint_field(hint, "code"), F.nullif(hint_field(hint, "alternates"), F.lit(""))), r"\|")
    return F.filter(found, lambda c: c != "")


def is_us_code(code: Column) -> Column:
    return F.coalesce(_up(code).isin(*US_CODES), F.lit(False))


def is_london_board(code: Column, symbol: Column) -> Column:
    return _up(code).isin("LN", "LO") & _up(symbol).rlike("^0[A-Z0-9]{3}$")


def market_symbol(code: Column, symbol: Column) -> Column:
    """Symbol with the suffix of its venue; null where there is none or the symbol is a board code."""
    suffix = code_field(code, "suffix")
    base = F.replace(symbol, F.lit("/"), F.lit(""))
    base = F.when(_up(code).isin(*NORDIC) & base.rlike("^[A-Z]{3,}[ABC]$"), F.regexp_replace(base, "(.)$", "-$1")).otherwise(base)
    usable = (suffix != "") & ~is_london_board(code, symbol) & (base != "")
    return F.when(usable, F.when(base.contains("."), base).otherwise(F.concat(base, suffix)))


def symbol_format(code: Column, symbol: Column) -> Column:
    return F.when(is_us_code(code), "us").when(code_field(code, "code").isNull(), "unknown").when(symbol.rlike("^[0-9]"), "numeric_suffixed").otherwise("suffixed")


def exchange_key(name: Column) -> Column:
    clean = F.coalesce(_up(name), F.lit(""))
    return F.coalesce(lookup(clean, EXCHANGE_KEYS), clean)


def venue_rank(mic: Column) -> Column:
    return F.coalesce(lookup(mic, VENUE_RANK), F.lit(OTHER_VENUE))


def is_us_venue(mic: Column) -> Column:
    return F.coalesce(mic.isin(*VENUE_RANK), F.lit(False))


def is_exchange_listed(mic: Column) -> Column:
    return is_us_venue(mic) & (mic != "OOTC")


def classify_security(kind: Column, description: Column) -> Column:
    t, d = F.upper(F.coalesce(kind, F.lit(""))), F.upper(F.coalesce(description, F.lit("")))
    return F.when(t.contains("ADR") | d.rlike(r"\bADR\b|\bADS\b"), "adr").when(t.contains("GDR") | d.rlike(r"\bGDR\b"), "gdr").when(t.contains("COMMON") | t.contains("EQS"), "ordinary").otherwise("other")


def kind_from_instrument(type1: Column, type2: Column, name: Column) -> Column:
    t = F.upper(F.concat_ws(" ", F.coalesce(type1, F.lit("")), F.coalesce(type2, F.lit("")), F.coalesce(name, F.lit(""))))
    return F.when(t.rlike(r"\bADR\b|AMERICAN DEPOSITARY"), "adr").when(t.rlike(r"\bGDR\b|GLOBAL DEPOSITARY"), "gdr").when(t.rlike("DEPOSITARY|DEPOSITORY"), "depositary").when(t.rlike("COMMON STOCK|ORDINARY|EQUITY"), "ordinary").otherwise("other")


def is_equity_line(type1: Column, type2: Column) -> Column:
    t1, t2 = F.upper(F.coalesce(type1, F.lit(""))), F.upper(F.coalesce(type2, F.lit("")))
    loose = t1.rlike("COMMON STOCK|ORDINARY|DEPOSITARY|EQUITY|REIT") & ~t1.rlike("FUTURE|OPTION|WARRANT|SWAP|INDEX")
    return F.when(t2 != "", t2.isin("COMMON STOCK", "DEPOSITARY RECEIPT")).otherwise(loose)


HOME_POINTS = 6  # fixed value: what a listing at home counts more; the rest of its quality is the same for all companies


def listing_quality(code: Column, ticker: Column, figi: Column, composite: Column, home: Column) -> Column:
    """How useful a listing is for finding its company's news; -1 rejects it."""
    t, e = F.upper(F.coalesce(ticker, F.lit(""))), F.upper(F.coalesce(code, F.lit("")))
    bad = t.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}") | (e == "TRACE") | is_london_board(e, t)
    points = [
        (home.isNotNull() & (code_field(e, "country") == home), HOME_POINTS),
        (market_symbol(e, F.coalesce(ticker, F.lit(""))).isNotNull(), 3),
        (is_us_code(e), 4),
        (composite == figi, 2),
        (~t.rlike("(USD|EUR|GBP|CHF|JPY|SEK|NOK|DKK)$"), 1),
    ]
    return F.when(bad, -1).otherwise(sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points), F.lit(0)))


def http_outcome(status: Column) -> Column:
    """Outcome of an HTTP status: refused, rate_limited, error or ok."""
    return F.when(status.isin(401, 403), "refused").when(status.isin(402, 429), "rate_limited").when(status >= 400, "error").when(status.isNotNull(), "ok")


def is_retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def locale(country: Column, field: int) -> Column:
    """Language (0), country (1) or edition (2) of a news search; US for other countries."""
    return F.coalesce(lookup(_up(country), {k: v[field] for k, v in LOCALES.items()}), F.lit(LOCALES["US"][field]))
