"""Companies that stories name exactly: the phrase join against the check of every pair."""

import random

from pyspark.sql import functions as F

from pressline.functions import relevance
from pressline.operators import resolution

NAMES = ["Red Widget Corp", "Red Widget Works", "Red-Widget Inc", "Red Widget Works Intl", "Orange plc", "Gap", "Kid ASA", "Acme", "Acme Gas", "Gas Works", "Été Works", "AT&T Gas Works", "Co", "", None, "X Y", "Foo_Bar Ltd", "Red Red Widget", "a b c d e f g"]
WORDS = ["red", "Red", "widget", "WIDGET", "works", "international", "Orange", "orange", "gap", "Gap", "acme", "gas", "ete", "été", "at&t", "shares", "profit", "foo", "bar", "foo_bar", "acme_gas", "x", "y", "-", "a b c d e f g"]


def tables(spark):
    r = random.Random(3)
    texts = ["red widget works international deal", "acme_gas shares", "", None, *("".join(r.choice(WORDS) + r.choice([" ", " ", "-", ", "]) for _ in range(r.randint(1, 8))) for _ in range(150))]
    return spark.createDataFrame(list(enumerate(texts)), "story_id long, text string"), spark.createDataFrame(list(enumerate(NAMES)), "id long, company_name string")


def test_mentions_are_those_of_every_pair(spark):
    stories, companies = tables(spark)
    pairs = stories.crossJoin(companies).filter(relevance.mentions_exactly(F.col("company_name"), F.col("text")))
    want = sorted(tuple(r) for r in pairs.select("story_id", "id").collect())
    assert len(want) > 40
    assert sorted(tuple(r) for r in resolution.story_mentions(stories, companies).collect()) == want


def test_names_that_begin_alike_meet_no_story_that_lacks_them(spark, monkeypatch):
    """A first word that all names share makes no pairs: the joins alone give what is there."""
    monkeypatch.setattr(relevance, "mentions_exactly", lambda company, text: F.lit(True))
    number = lambda n: F.lpad(n.cast("string"), 9, "0")
    companies = spark.range(3000).select("id", F.concat(F.lit("Supplier#"), number(F.col("id"))).alias("company_name"))
    stories = spark.range(200).select(F.col("id").alias("story_id"), F.concat(F.lit("Markets: Supplier#"), number(F.col("id") * 7), F.lit(" and rates")).alias("text"))
    assert sorted(tuple(r) for r in resolution.story_mentions(stories, companies).collect()) == [(i, 7 * i) for i in range(200)]
