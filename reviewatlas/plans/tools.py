"""The analytic tools by name, for one product. Child ids are accepted.

Each tool is a filter on a set-wise operator: the product's family is a one-row lookup that
Spark joins first, so only that family's rows are read and aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.operators import compare, evidence, stats
from reviewatlas.operators.linkage import parent_lookup
from reviewatlas.plans.fixtures import Tables


def family_of(t: Tables, asin: str, name: str = "parent_asin") -> DataFrame:
    """The family of a product id; an unknown id stands for itself."""
    asked = t.spark.range(1).select(F.lit(asin).alias("asin"))
    known = parent_lookup(t.products.filter((F.col("asin") == asin) | (F.col("parent_asin") == asin))).filter(F.col("asin") == asin)
    return asked.join(known, "asin", "left").select(F.coalesce("parent_asin", "asin").alias(name))


def _only(df: DataFrame, family: DataFrame, column: str = "parent_asin") -> DataFrame:
    return df.join(family.select(F.col(family.columns[0]).alias(column)), column, "left_semi")


def get_product_dna(t: Tables, asin: str) -> DataFrame:
    family = family_of(t, asin)
    reviews, tags = _only(t.reviews, family), _only(t.review_tags, family)
    impact = stats.estimated_impact(t.products, reviews, tags, t.aspect_mapping)
    kpis = stats.product_kpis(_only(t.products, family, "asin"), reviews)
    return evidence.product_dna(t.products, _only(t.product_parents, family), kpis, impact)


def search_review_evidence(t: Tables, asin: str, aspect: str | None = None, sentiment: str | None = None, keyword: str | None = None) -> DataFrame:
    tags = _only(t.review_tags_quoted, family_of(t, asin))
    reviews = t.reviews_text if keyword else t.reviews
    return evidence.search_evidence(tags, reviews, t.aspect_mapping, None, aspect, sentiment, keyword)


def find_better_alternatives(t: Tables, asin: str, criteria: str | None = "Quality") -> DataFrame:
    found = compare.better_alternatives(t.products, t.product_parents, t.review_tags, t.aspect_mapping, criteria)
    return _only(found, family_of(t, asin), "for_asin")


def get_product_swot(t: Tables, asin: str) -> DataFrame:
    return compare.swot(_only(t.review_tags_quoted, family_of(t, asin)), t.aspect_mapping)


def compare_head_to_head(t: Tables, asin_a: str, asin_b: str) -> DataFrame:
    a, b = family_of(t, asin_a, "a"), family_of(t, asin_b, "b")
    pair = a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
    both = a.toDF("parent_asin").unionByName(b.toDF("parent_asin"))
    return compare.head_to_head(_only(t.review_tags, both), t.aspect_mapping, pair)


def analyze_customer_context(t: Tables, asin: str) -> DataFrame:
    return evidence.customer_context(_only(t.reviews_text, family_of(t, asin)))


def generate_listing_content(t: Tables, asin: str) -> DataFrame:
    family = family_of(t, asin)
    return evidence.listing_brief(_only(t.products, family, "asin"), _only(t.review_tags, family), t.aspect_mapping)


def analyze_competitors(t: Tables, asin: str) -> DataFrame:
    found = compare.competitor_gaps(t.products, t.product_parents, t.review_tags, t.aspect_mapping)
    return _only(found, family_of(t, asin), "for_asin")


# The tools' names.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        get_product_dna, search_review_evidence, find_better_alternatives, get_product_swot, compare_head_to_head,
        analyze_customer_context, generate_listing_content, analyze_competitors,
    )
}


def call(name: str, tables: Tables, **arguments: str) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name!r}; known: {', '.join(TOOLS)}")
    return TOOLS[name](tables, **arguments)
