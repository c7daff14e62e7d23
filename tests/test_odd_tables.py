"""Queries against their SQL on small tables made of what the given ones lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pressline.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def same(spark, folder, name, **tables):
    """Does the query give what its SQL gives over these frames?"""
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


WORDS = "ab cd efg " * 67
TEXTS = [
    None, "", " ", "\n\t", "\u00a0", "one", "a\x0bb  c\x0b", "\u00a0 one two\u3000", " \u2003x\u2028", "\x1cx\x1c y",
    *("word " * n for n in (199, 200, 201, 400, 401)), "\u3000".join(["word"] * 300), "x\x0b" * 700, "x" * 700, "x" * 701,
    WORDS + "x" * 100, WORDS + "\u00a0 " * 20 + "x" * 100, WORDS + "\u00a0" * 40 + "x" * 100, WORDS + " \u0301\u0301" + "y" * 100, WORDS + "\u0600 y" + "y" * 100,
    "x" * 499 + " \u0301\u0301\u0301" + "y" * 300, "x" * 501 + " \u0301" + "y" * 300, "é" * 600 + " " + "\U0001f600" * 200, WORDS + " \u200d\U0001f600" + "z" * 100, WORDS + " \U0001f3fb" + "z" * 90, WORDS + "\u0e33 \u0903" + "z" * 90,
]


def test_previews_of_odd_texts(spark, tmp_path):
    same(spark, tmp_path, "preview_and_reading_time", documents=spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


@pytest.fixture(scope="module")
def busy_events(spark):
    """More events a day than a source's ceiling: a plain day, one with more to come and one whose last page fails."""
    day = F.when(F.col("id") < 20_300, 4).when(F.col("id") < 30_400, 5).when(F.col("id") < 50_410, 7).otherwise(8)
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), day, F.lit(10), F.lit(0), F.lit(0))
    return spark.range(50_500).select(F.col("id").alias("event_id"), at.alias("ts"), F.concat(F.lit("kind "), (F.col("id") % 5).cast("string")).alias("event_type"))


def test_articles_of_days_above_the_ceiling(spark, tmp_path, busy_events):
    same(spark, tmp_path, "paged_articles", events=busy_events)


def test_windows_of_days_above_the_ceiling(spark, tmp_path, busy_events):
    same(spark, tmp_path, "paged_windows", events=busy_events)


def test_streamed_articles_of_days_above_the_ceiling(spark, tmp_path, busy_events):
    same(spark, tmp_path, "stream_paged_articles", events=busy_events)
