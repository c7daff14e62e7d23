"""Link counts of articles as a maintained aggregate.

What a feed needs of an article's links beyond its page is their number and the best relevance
(the round-up penalty and the filters by company count).  Both are kept by article in a
:class:`pressline.sources.keyed.KeyedStore` and follow from the links that a batch adds and
removes, so a read never aggregates all links.  A best value can't be lowered by a difference, so
the number of links of each relevance is kept: relevance has two decimals, hence at most 101.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "article_id bigint, company_count bigint, best decimal(3,2), held map<decimal(3,2),bigint>"


def changes(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Differences (article_id, relevance, n) of links (article_id, relevance) that come and go, pre-aggregated."""
    rows = added.select("article_id", F.col("relevance").cast("decimal(3,2)").alias("relevance"), F.lit(1).cast("bigint").alias("n"))
    if removed is not None:
        rows = rows.unionByName(removed.select("article_id", F.col("relevance").cast("decimal(3,2)").alias("relevance"), F.lit(-1).cast("bigint").alias("n")))
    return rows.groupBy("article_id", "relevance").agg(F.sum("n").alias("n")).filter("n <> 0")


def merged_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences between two states of the links of some articles, as of a merge of articles."""
    return changes(after, before)


def fold(old: DataFrame, differences: DataFrame) -> DataFrame:
    """Counts after differences; a merge of a KeyedStore of SCHEMA.  Articles without links left have no row.

    Links without a relevance count under the relevance -1, which is never the best.
    """
    none = F.lit("-1").cast("decimal(3,2)")
    plus = differences.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("relevance", none).alias("r"), "n"))).alias("plus"))
    both = old.select("article_id", "held").join(plus, "article_id", "full_outer")
    empty = F.expr("cast(map() as map<decimal(3,2),bigint>)")
    added = F.map_zip_with(F.coalesce("held", empty), F.coalesce("plus", empty), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    now = both.withColumn("held", F.map_filter(added, lambda k, n: n > 0)).filter(F.size("held") > 0)
    total = F.aggregate(F.map_values("held"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    best = F.array_max(F.filter(F.map_keys("held"), lambda k: k >= 0))
    return now.select("article_id", total.alias("company_count"), best.alias("best"), "held")
