"""Single-product tools give the rows of the set-wise operators."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import compare, evidence, stats
from reviewatlas.plans import tools
from reviewatlas.plans.fixtures import Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


CHILD, PARENT = "A000000012", "A000000010"


def test_family(t):
    assert rows(tools.family_of(t, CHILD)) == [(PARENT,)]
    assert rows(tools.family_of(t, "nope")) == [("nope",)]


def test_tools_equal_the_operators(t):
    tags, mapping = t.review_tags, t.aspect_mapping
    impact = stats.estimated_impact(t.products, t.reviews, tags, mapping)
    kpis = stats.product_kpis(t.products, t.reviews)
    whole = {
        "get_product_dna": evidence.product_dna(t.products, t.product_parents, kpis, impact).filter(F.col("parent_asin") == PARENT),
        "get_product_swot": compare.swot(t.review_tags_quoted, mapping).filter(F.col("parent_asin") == PARENT),
        "analyze_customer_context": evidence.customer_context(t.reviews_text).filter(F.col("parent_asin") == PARENT),
        "generate_listing_content": evidence.listing_brief(t.products, tags, mapping).filter(F.col("asin") == PARENT),
        "search_review_evidence": evidence.search_evidence(t.review_tags_quoted, t.reviews, mapping, asin=PARENT),
        "find_better_alternatives": compare.better_alternatives(t.products, t.product_parents, tags, mapping).filter(F.col("for_asin") == PARENT),
        "analyze_competitors": compare.competitor_gaps(t.products, t.product_parents, tags, mapping).filter(F.col("for_asin") == PARENT),
    }
    for name, want in whole.items():
        got = tools.call(name, t, asin=CHILD)
        expected = rows(want)
        assert rows(got.select(*want.columns)) == expected, name
        assert expected, name


def test_head_to_head(t):
    pair = t.pairs.filter(F.col("a") == PARENT)
    want = rows(compare.head_to_head(t.review_tags, t.aspect_mapping, pair))
    assert rows(tools.call("compare_head_to_head", t, asin_a=CHILD, asin_b="A000000015")) == want
    assert want


def test_unknown_tool(t):
    with pytest.raises(KeyError):
        tools.call("other", t)
