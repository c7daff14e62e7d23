"""What the plans of the headline queries have to show."""

import contextlib
import io

import pytest

from pressline.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_feed_pages_are_cut_before_children_join(spark):
    text = plan(spark, "feed_company_news")
    assert "TakeOrderedAndProject" in text
    assert "PushedFilters: [IsNotNull" in text


def test_scans_read_what_is_used(spark):
    text = plan(spark, "service_counts")
    assert "l_comment" not in text and "o_orderdate" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text


def test_latest_per_key_limits_groups_early(spark):
    assert "WindowGroupLimit" in plan(spark, "latest_outcome_per_company")


@pytest.mark.parametrize("name", ["name_similarity_pairs", "market_story_mentions", "resolve_hints", "expand_listings", "merge_colliding_links", "connectivity_states", "coverage_gaps"])
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
