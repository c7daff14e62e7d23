"""Golden pairs of the scalar library."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressline.functions import control, exchange, hashing, names, relevance, text, url


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_url_variants_share_a_canonical_form(spark):
    forms = ["https://www.reuters.com/business/acme-results/?utm_source=x&utm_medium=y", "http://reuters.com/business/acme-results", "https://reuters.com/business/acme-results#top", "https://www.reuters.com/business//acme-results/amp/", "HTTPS://user@Reuters.com:8443/business/acme-results?fbclid=1"]
    got = values(spark, [(f,) for f in forms], "u string", url.canonical_url(F.col("u")))
    assert {g[0] for g in got} == {"https://reuters.com/business/acme-results"}


@pytest.mark.parametrize(
    "raw,want",
    [
        ("https://a.com/?b=2&a=1", "https://a.com/?a=1&b=2"),
        ("https://a.com?a=2&a=1", "https://a.com/?a=2&a=1"),
        ("https://a.com/x?q=a b&r", "https://a.com/x?q=a+b&r="),
        ("https://a.com/amp/b/amp/c", "https://a.com/b/amp/c"),
        ("  Not A URL ", "not a url"),
        ("https://a.com/", "https://a.com/"),
    ],
)
def test_canonical_details(spark, raw, want):
    assert values(spark, [(raw,)], "u string", url.canonical_url(F.col("u"))) == [(want,)]


def test_canonical_null(spark):
    assert values(spark, [(None,)], "u string", url.canonical_url(F.col("u"))) == [(None,)]


def test_hosts(spark):
    rows = [("https://www.chartmill.com/a",), ("https://x.chartmill.com/a",), ("https://notchartmill.com/a",), (None,), ("junk",), ("https://news.google.com/rss/articles/x",), ("https://finnhub.io/api/news?id=1",)]
    u = F.col("u")
    got = values(spark, rows, "u string", url.is_dead_host(u), url.is_readable(u), url.is_wrapper(u))
    assert got == [(True, False, False), (True, False, False), (False, True, False), (False, False, False), (False, False, False), (False, False, False), (False, True, True)]


def test_safe_and_public_links(spark):
    rows = [("https://Example.com/a",), ("http://example.com/a",), ("https://u:p@example.com",), ("https://localhost/a",), ("https://10.0.0.1/a",), ("https://x.local/",), ("https://example.com/?token=1",)]
    got = values(spark, rows, "u string", url.safe_public_url(F.col("u")), url.is_public_link(F.col("u")))
    assert [g[0] for g in got] == ["https://example.com/a", None, None, None, None, None, "https://example.com/?token=1"]
    assert [g[1] for g in got] == [True, True, False, False, False, False, False]


def test_fetch_rules(spark):
    rows = [("fed", "body", "https://www.federalreserve.gov/newsevents/pressreleases/monetary20240131a.htm"), ("fed", "body", "https://www.federalreserve.gov/newsevents/pressreleases/monetary20240131a.htm?x=1"), ("ecb", "body", "https://www.ecb.europa.eu//press/pr/date/2024/html/ecb.mp240125~f1.en.html"), ("sec", "body", "https://www.sec.gov/Archives/edgar/data/1/000000000124000001/%2e%2e/x.htm"), ("benzinga", "api", "https://api.benzinga.com/api/v2/news?token=x"), ("benzinga", "api", "https://api.benzinga.com:444/api/v2/news")]
    got = values(spark, rows, "p string, w string, u string", url.allowed(F.col("u"), F.col("p"), F.col("w")))
    assert [g[0] for g in got] == [True, False, True, False, True, False]


def test_syndication_hash(spark):
    rows = [("Acme beats estimates!", datetime(2024, 1, 2, 3)), ("ACME beats   estimates", datetime(2024, 1, 2, 22)), ("Acme beats estimates", datetime(2024, 1, 3))]
    got = values(spark, rows, "h string, t timestamp", hashing.content_hash(F.col("h"), F.col("t")))
    assert got[0] == got[1] != got[2]
    assert len(got[0][0]) == 40


def test_headlines_keep_other_scripts(spark):
    rows = [("Société Générale: “hausse”",), ("日本 株式",), ("ﬁne",)]
    h = F.col("h")
    got = values(spark, rows, "h string", text.normalize_headline(h), text.exact_headline(h))
    assert got == [("societe generale 'hausse'",) * 2, ("日本 株式",) * 2, ("ﬁne", "fine")]


@pytest.mark.parametrize("raw,key", [("TOYOTA MOTOR CORP -SPON ADR", "toyota motor"), ("NESTLE SA-REG", "nestle"), ("BRINK'S CO", "brinks"), ("AT&T Inc", "att"), ("TABOOLA.COM LTD", "taboola"), ("Safran L", "safran"), ("Moët Hennessy Louis Vuitton SE", "moet hennessy louis vuitton"), ("BABCOCK INTL GROUP PLC", "babcock international"), ("", ""), ("The Group", "")])
def test_name_keys(spark, raw, key):
    assert values(spark, [(raw,)], "n string", names.normalize_name(F.col("n"))) == [(key,)]
    assert names.key_of(raw) == key


@pytest.mark.parametrize(
    "left,right,match",
    [
        ("Balfour Beatty PLC", "BEST BUY CO INC", False),
        ("Babcock International Group PLC", "BABCOCK INTL GROUP PLC", True),
        ("Admiral Group", "ARCHER-DANIELS-MIDLAND", False),
        ("Novo Nordisk A/S", "NOVO NORDISK A/S-B", True),
        ("Apple", "Apple Hospitality REIT", False),
        ("Auto Trader", "AUTOTRADER", True),
        ("Construcciones y Auxiliar de Ferrocarriles", "CONSTRUCC Y AUX DE FERROCARR", True),
        ("Martin Marietta Materials", "H & M Hennes & Mauritz", False),
        ("Wabtec", "Westinghouse Air Brake Technologies Corp", True),
        ("Shanghai Airport", "Shanghai Electric", False),
        ("", "Anything", False),
    ],
)
def test_name_similarity(spark, left, right, match):
    [(s,)] = values(spark, [(left, right)], "l string, r string", names.name_similarity(F.col("l"), F.col("r")))
    assert 0 <= s <= 1 and (s >= names.MATCH_AT) is match


def test_renames_share_tokens_and_collisions_do_not(spark):
    rows = [("Sterling Construction", "STERLING INFRASTRUCTURE"), ("Admiral Group", "ARCHER-DANIELS-MIDLAND")]
    assert values(spark, rows, "l string, r string", names.shared_tokens(F.col("l"), F.col("r"))) == [(1,), (0,)]


def test_search_names_and_variants(spark):
    rows = [("Per Aarsleff Holding A/S (B)", "LVMH_F"), ("Group plc", "sapg.f")]
    got = values(spark, rows, "n string, t string", names.searchable_name(F.col("n")), names.home_country(F.col("n")), names.ticker_variants(F.col("t")))
    assert got == [("Per Aarsleff", "DK", ["LVMH_F", "LVMH.F"]), ("Group plc", "GB", ["SAPG.F", "SAPG_F"])]


def test_issuer_keys(spark):
    rows = [("ASML Holding N.V.",), ("Acme, Inc.",), ("Alphabet Inc Class A",)]
    assert values(spark, rows, "n string", names.issuer_key(F.col("n"))) == [("asml holding nv",), ("acme",), ("alphabet inc class a",)]


def test_market_symbols(spark):
    rows = [("LN", "VOD"), ("JT", "7203"), ("LN", "QQ/"), ("LN", "0M6I"), ("SS", "CLASB"), ("US", "AAPL"), ("ZZ", "X"), ("GR", "SAP.DE")]
    got = values(spark, rows, "e string, s string", exchange.market_symbol(F.col("e"), F.col("s")), exchange.symbol_format(F.col("e"), F.col("s")))
    assert got == [("VOD.L", "suffixed"), ("7203.T", "numeric_suffixed"), ("QQ.L", "suffixed"), (None, "numeric_suffixed"), ("CLAS-B.ST", "suffixed"), (None, "us"), (None, "unknown"), ("SAP.DE", "suffixed")]


def test_hints_take_the_last_row_and_codes_the_first(spark):
    [got] = values(spark, [("shse", "CN")], "h string, c string", exchange.hint_field(F.col("h"), "code"), exchange.code_field(F.col("c"), "suffix"))
    assert got == ("C1", ".TO")


def test_source_tiers(spark):
    rows = [("Reuters",), ("Reuters Events",), ("Yahoo Finance",), ("barron's",), (None,), ("Local Blog",)]
    assert [g[0] for g in values(spark, rows, "s string", relevance.source_tier(F.col("s")))] == [1, 1, 3, 2, 3, 3]


@pytest.mark.parametrize(
    "company,headline,ok",
    [
        ("Kid ASA", "‘Club Kid’ Trailer drops", False),
        ("Jensen-Group", "Jensen Huang on redefining things", False),
        ("Broadcom Inc", "Broadcom Announces Q3 Results", True),
        ("Bloom Energy", "Energy prices climb", False),
        ("Bloom Energy", "Bloom Energy wins contract", True),
        ("Société Générale", "Société Générale lifts outlook", True),
        ("3M Co", "3M raises dividend", True),
        ("AT&T Inc", "AT&T earnings beat", True),
        ("Brink's Co", "Brink's shares climb", False),
        ("Holding AG", "Shares climb", False),
    ],
)
def test_name_verification(spark, company, headline, ok):
    got = values(spark, [(company, headline)], "c string, h string", *relevance.verify_name(F.col("c"), F.col("h"), F.lit(None).cast("string")))
    assert got[0][0] is ok and got[0][1]


def test_exact_mentions(spark):
    rows = [("Booking Holdings", "we're booking a five-fold profit"), ("Booking Holdings", "Booking posts profit"), ("Red Widget Corp", "a red-widget deal"), ("Gap", "gap shares")]
    assert [g[0] for g in values(spark, rows, "c string, t string", relevance.mentions_exactly(F.col("c"), F.col("t")))] == [False, True, True, False]


def test_plain_text(spark):
    html = "<p>A &amp; B&#33;</p><script>x()</script><!-- c --><div>C&nbsp;D &#xD800; &bogus;</div><style>unclosed"
    assert values(spark, [(html,)], "h string", text.plain_text(F.col("h"))) == [("A & B!\n\nC D &bogus;",)]
    assert text.python_plain_text(html) == "A & B!\n\nC D &bogus;"


def test_preview_and_minutes(spark):
    long = "word " * 200
    rows = [("  a  b ",), (long,), ("x" * 900,), (" ",), (None,)]
    got = values(spark, rows, "t string", text.preview_text(F.col("t")), text.reading_minutes(F.col("t")))
    assert got[0] == ("a b", 1)
    assert got[1][0] == ("word " * 140).rstrip() + "…" and got[1][1] == 1
    assert got[2][0] == "x" * 699 + "…"
    assert got[3][0] is None and got[4] == (None, None)


def test_figures_and_bodies():
    page = '<figure><img src="http://a/x.png"><figcaption>no</figcaption></figure><figure><img src="https://a/x.png" alt="&lt;"><figcaption>Cap. Credit: Me</figcaption></figure>'
    assert text.figure_image_of(page) == {"src": "https://a/x.png", "alt": "<", "caption": "Cap. Credit: Me", "credit": "Me"}
    assert text.figure_image_of(None) is None
    nested = '<main><div class="section"><div>' + "word " * 20 + "</div>tail</div>after</main>"
    assert text.official_body_of("ecb", nested).endswith("tail")
    assert text.official_body_of("ecb", "<p>no main</p>") is None


def test_redaction(spark):
    rows = [("https://a.com/?token=abc&x=1",), ("failed: api_key=abc, again",)]
    assert values(spark, rows, "u string", url.redact(F.col("u"))) == [("https://a.com/?token=REDACTED&x=1",), ("failed: api_key=REDACTED again",)]


def test_cursors():
    c = control.encode_cursor("2024-01-02T03:04:05.000Z", "legacy:12", "all")
    assert control.decode_cursor(c, "all") == ("2024-01-02T03:04:05.000Z", "legacy:12")
    assert control.decode_cursor(None, "all") is None
    for bad, source in ((c, "free"), ("x" * 501, "all"), ("%%%", "all"), (control.encode_cursor("2024-01-02", "no", "all"), "all"), (control.encode_cursor("never", "legacy:1", "all"), "all")):
        with pytest.raises(control.InvalidCursor):
            control.decode_cursor(bad, source)


def test_cron_steps_count_from_the_first_value():
    assert control.cron_values("*/3", 1, 12) == {1, 4, 7, 10}
    assert control.cron_matches("0 6 * * 0", datetime(2024, 1, 7, 6, 0))
    assert not control.cron_matches("0 6 * *", datetime(2024, 1, 7, 6, 0))
    assert control.cron_values("5-9/2,20", 0, 59) == {5, 7, 9, 20}


def test_http_outcomes(spark):
    got = values(spark, [(401,), (402,), (429,), (500,), (404,), (200,), (None,)], "s int", exchange.http_outcome(F.col("s")), exchange.is_retryable(F.col("s")))
    assert got == [("refused", False), ("rate_limited", False), ("rate_limited", True), ("error", True), ("error", False), ("ok", False), (None, False)]
