"""Redaction of nested values, windows of sources, and the exports."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressline.functions import control, url
from pressline.operators import analytics, reads
from pressline.sources import files, sinks


def test_redaction_reaches_nested_strings(spark):
    secret = "k&y/ 1"
    schema = "id long, a string, s struct<t:string,n:long,u:array<struct<v:string>>>, m map<string,array<string>>, `odd.name` string"
    row = (1, f"x {secret} y", (secret, 7, [(f"a{secret}",), (None,), ("k%26y%2F%201",)]), {secret: [secret, "fine"]}, secret)
    df = spark.createDataFrame([row, (2, None, None, None, None)], schema)
    out = url.redacted(df, [f" {secret} ", "", None])
    assert out.schema.simpleString() == df.schema.simpleString()
    one, two = out.orderBy("id").collect()
    assert (one["a"], one["s"]["t"], one["s"]["n"]) == ("x [redacted] y", "[redacted]", 7)
    assert [v["v"] for v in one["s"]["u"]] == ["a[redacted]", None, "[redacted]"]
    assert one["m"] == {secret: ["[redacted]", "fine"]} and one["odd.name"] == "[redacted]"
    assert tuple(two) == (2, None, None, None, None)
    assert url.redacted(df, []).collect() == df.collect()


def test_windows_go_on_page_by_page():
    now = datetime(2024, 5, 1, 12)
    first = control.window_of(None, now)
    assert first == (now - timedelta(hours=1), now, 0, "news")
    page = control.after_page(first, True)
    assert control.window_of(page, now + timedelta(days=1)) == (first.start, first.end, 1, "news")
    removed = control.after_page(control.window_of(page, now), False, ("news", "removed"))
    assert control.window_of(removed, now) == (first.start, first.end, 0, "removed")
    done = control.after_page(control.window_of(removed, now), False, ("news", "removed"))
    assert done == {"watermark": now.isoformat()}
    later = now + timedelta(hours=3)
    assert control.window_of(done, later) == (now - timedelta(minutes=5), later, 0, "news")
    good = {"kind": "window", "from": now.isoformat(), "to": later.isoformat(), "page": 0}
    for bad in ({"page": -1}, {"page": 100_001}, {"page": "1"}, {"to": (now - timedelta(hours=1)).isoformat()}, {"from": "never"}):
        with pytest.raises(ValueError):
            control.window_of(good | bad, now)


def test_exports(spark, tmp_path):
    companies = spark.createDataFrame([(1, "B", "Beta", "GB", "beta", "resolved", None, True), (2, "A", "Acme, Inc", "US", "acme", "unresolved", "rejected: no", True), (3, "C", "Gone", "US", "gone", "resolved", None, False)], "id long, ticker string, company_name string, country string, name_normalized string, resolution_status string, resolution_note string, is_active boolean")
    listings = spark.createDataFrame([(10, 1, "LN", "XLON", "BET", "GBP", False, False, 0.9), (11, 1, "US", "OOTC", "BETAY", "USD", False, True, 0.95), (12, 1, "FP", "XPAR", "BE", "EUR", True, False, 0.5)], "id long, company_id long, exchange_code string, mic string, symbol string, currency string, is_primary boolean, is_us boolean, confidence double")
    out = reads.listing_export(companies, listings)
    assert len(out.columns) == 21
    assert [(r["catalogue_ticker"], r["symbol"], r["isin"]) for r in out.collect()] == [("A", None, None), ("B", "BE", None), ("B", "BETAY", None), ("B", "BET", None)]
    gaps = analytics.gap_export(companies, listings, spark.createDataFrame([(3,)], "company_id long"))
    sinks.write_gaps(gaps, str(tmp_path / "gaps"))
    back = files.read_csv(spark, str(tmp_path / "gaps"), ", ".join(f"{c} string" for c in sinks.GAP_COLUMNS))
    assert sorted((r["ticker"], r["country"], r["gap_reason"], r["note"] or "") for r in back.collect()) == [("A", "US", "unresolved_name_check_rejected", "rejected: no"), ("B", "GB", "no_news_otc_only", "")]
    assert F is not None
