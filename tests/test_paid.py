"""Records of licensed sources as common articles, and both phases of a window in one revision history."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressline.operators import state
from pressline.sources import files, paid


def test_summaries_with_companies(spark):
    rows = spark.createDataFrame([("m1", "https://news.example.com/a", "Acme <b>earnings</b> and CPI", None, "snip &amp; pet", None, "en", "2024-01-02T03:04:05Z", [("ACM", "Acme", "NYSE", "us"), ("", "", "x", "y"), (None, "Beta", None, None)]), ("m2", "https://news.example.com/b", "Plain", "d", None, "Desk", "", "2024-01-02T03:04:05Z", None)], paid.MARKETAUX)
    one, two = paid.marketaux(rows).orderBy("source_id").collect()
    assert (one["headline"], one["summary"], one["publisher"], one["topics"], one["published_at"]) == ("Acme earnings and CPI", "snip & pet", "news.example.com", ["earnings", "inflation"], datetime(2024, 1, 2, 3, 4, 5))
    assert [tuple(c) for c in one["companies"]] == [("ACM", "NYSE", "US", "Acme", "marketaux:ACM:NYSE:us"), (None, None, None, "Beta", "marketaux:::")]
    assert (two["topics"], two["companies"], two["language"], two["publisher"]) == (["markets"], [], None, "Desk")
    for bad in ({"uuid": None}, {"url": "http://news.example.com/a"}, {"title": " "}, {"published_at": "soon"}):
        with pytest.raises(files.InvalidSource):
            paid.marketaux(rows.withColumns({k: F.lit(v).cast("string") for k, v in bad.items()}))


def test_news_then_removals_of_a_window(spark):
    end = datetime(2024, 1, 2)
    rows = spark.createDataFrame([("1", "https://www.benzinga.com/1", "Federal Reserve holds", "t", "<p>Body</p>", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", True, [("Rates",)], [("ABC", "NYSE", "US000"), ("DEF", None, None)]), ("2", "https://www.benzinga.com/2", "Later", None, None, "2024-01-01T00:00:00Z", "2024-01-02T01:00:00Z", None, None, None), ("3", "https://www.benzinga.com/3", "Gone soon", None, "<p>x</p>", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00Z", None, None, None)], paid.BENZINGA)
    news = paid.benzinga(rows, end, full_text=True)
    first = news.filter("source_id = '1'").first()
    assert (first["body"], first["body_allowed"], first["correction"], first["topics"]) == ("Body", True, True, ["monetary-policy"])
    assert [tuple(c)[0::4] for c in first["companies"]] == [("ABC", "isin:US000"), ("DEF", None)]
    assert sorted(r["source_id"] for r in news.collect()) == ["1", "3"]
    assert paid.benzinga(rows, end).filter("body IS NOT NULL OR body_allowed").count() == 0
    gone = paid.benzinga_removed(spark.createDataFrame([("3",)], "id string"))
    events = news.withColumn("seq", F.lit(1)).unionByName(gone.withColumn("seq", F.lit(2)), allowMissingColumns=True).withColumn("companies", F.to_json("companies"))
    now = {r["source_id"]: (r["headline"], r["body"], r["url"], r["deleted"]) for r in state.current(state.revisions(events)).collect()}
    assert now == {"1": ("Federal Reserve holds", "Body", "https://www.benzinga.com/1", False), "3": (state.WITHDRAWN, None, "https://www.benzinga.com/3", True)}
    with pytest.raises(files.InvalidSource):
        paid.benzinga_removed(spark.createDataFrame([("",)], "id string"))


def test_queries_by_symbol(spark):
    rows = spark.createDataFrame([("7", "https://a.example.com/x", "Head", "s", "", 1704067200)], paid.FINNHUB)
    one = paid.finnhub(rows, "ABC").first()
    assert (one["publisher"], one["published_at"], one["companies"][0]["ticker"], one["companies"][0]["external_id"]) == ("a.example.com", datetime(2024, 1, 1), "ABC", "finnhub-query:ABC")
    assert paid.finnhub(rows).first()["companies"] == [] and paid.finnhub(rows.limit(0)).collect() == []
    both = files.provider_articles(paid.finnhub(rows), paid.benzinga_removed(spark.createDataFrame([("3",)], "id string")).withColumn("companies", F.lit(None).cast(f"array<{paid.COMPANY}>")))
    assert sorted(r["action"] for r in both.collect()) == ["delete", "upsert"]
