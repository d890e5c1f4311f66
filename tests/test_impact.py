"""Statistics on planted rows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.functions.frames import keep_one
from reviewatlas.operators import aspects, quality, stats
from reviewatlas.plans.fixtures import Tables

PRODUCT = "asin string, parent_asin string, real_average_rating double, real_total_ratings bigint, variation_count int, rating_breakdown string"
REVIEW = "review_id string, parent_asin string, child_asin string, rating_score double, review_date date"
TAG = "tag_id string, review_id string, parent_asin string, aspect string, sentiment string"
MAPPING = "raw_aspect string, standard_aspect string, category string"


def impact(frame, product, reviews, tags, mapping=()):
    got = stats.estimated_impact(
        frame([product], PRODUCT), frame(reviews, REVIEW), frame(tags, TAG), frame(list(mapping), MAPPING)
    )
    return rows(got, "aspect", "est_positive", "est_negative", "net_impact", "total_impact_vol")


def test_two_reviews_without_histogram(frame):
    """Two sampled reviews spread over five stars: 0.4 each, which truncates to nothing."""
    reviews = [("r1", "P", "C", 5.0, None), ("r2", "P", "C", 1.0, None)]
    tags = [("t1", "r1", "P", "soft", "Positive"), ("t2", "r2", "P", "zip", "Negative")]
    assert impact(frame, ("P", "P", None, 0, None, None), reviews, tags) == [("soft", 0, 0, 0, 0), ("zip", 0, 0, 0, 0)]


def test_population_weights_and_neutral(frame):
    reviews = [("r1", "P", "C", 5.0, None), ("r2", "P", "C", 5.0, None), ("r3", "P", "C", 1.0, None), ("r4", "P", "C", 0.0, None)]
    tags = [
        ("t1", "r1", "P", "soft", "Positive"), ("t2", "r2", "P", "SOFT", "Neutral"), ("t3", "r3", "P", "soft", "Negative"),
        ("t4", "r4", "P", "ghost", "Positive"), ("t5", "gone", "P", "soft", "Positive"),
    ]
    mapping = [("soft", "Softness", "Comfort")]
    product = ("P", "P", 4.0, 1000, None, '{"5": 90, "1": 10}')
    # 900 real reviews behind two sampled at 5 stars, 100 behind one at 1 star; a star outside
    # 1..5 and a tag without a review count for nothing, an upper-case raw term is not mapped
    assert impact(frame, product, reviews, tags, mapping) == [("SOFT", 0, 450, -450, 450), ("Softness", 450, 100, 350, 550)]


@pytest.mark.parametrize(("text", "share"), [(None, 200.0), ("{}", 200.0), ("", 200.0), ("bad", 200.0), ('{"5": 0}', 0.0)])
def test_population_without_usable_histogram(frame, text, share):
    reviews = frame([("r1", "P", "C", 5.0, None)], REVIEW)
    got = stats.population(frame([("P", "P", None, 1000, None, text)], PRODUCT), reviews)
    assert rows(got, *[f"real{s}" for s in stats.STARS]) == [(share,) * 5]


def test_real_counts_add_up(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    pop = stats.population(t.products, t.reviews)
    total = sum((F.col(f"real{s}") for s in stats.STARS), F.lit(0.0))
    assert pop.filter(F.abs(total - F.col("real_total")) > 1e-6).count() == 0


def test_kpi_fallbacks(frame):
    products = frame([("P", "P", None, None, 0, '{"1": 1, "2": 1, "5": 2}'), ("Q", "Q", 4.5, 9, 3, None)], PRODUCT)
    reviews = frame([("r1", "P", "C1", 4.0, None), ("r2", "P", "C2", 2.0, None), ("r3", "X", "C3", 1.0, None)], REVIEW)
    got = rows(stats.product_kpis(products, reviews), "asin", "total_reviews", "avg_rating", "total_variations", "neg_pct", "is_fallback")
    assert got == [("P", 2, 3.0, 2, 50.0, False), ("Q", 9, 4.5, 3, 0.0, False), ("X", 1, 1.0, 0, 0.0, True)]


def test_norm_join_never_adds_tags(frame):
    tags = frame([("t1", "r", "P", " Soft", "Positive"), ("t2", "r", "P", "soft", "Positive")], TAG)
    mapping = frame([("soft", "Softness", "c"), ("SOFT ", "Other", "c"), (None, "x", "c")], MAPPING)
    exact = rows(aspects.aspect_counts(tags, mapping, "exact"), "aspect", "mentions")
    normed = rows(aspects.aspect_counts(tags, mapping, "norm"), "aspect", "mentions")
    assert exact == [(" Soft", 1), ("Softness", 1)]
    assert normed == [("Other", 2)]
    with pytest.raises(ValueError):
        aspects.resolve_aspects(tags, mapping, "fuzzy")


def test_dedup_keeps_and_deletes_all(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    kept = quality.dedup_tags(t.review_tags_quoted, t.aspect_mapping).count()
    counted = dict(rows(quality.dedup_stats(t.review_tags_quoted)))
    assert counted["KEEP"] == kept
    assert sum(counted.values()) == t.review_tags.count()


def test_overlap_of_two_sources(spark):
    left = spark.range(500).select(F.col("id").cast("string").alias("review_id"))
    right = spark.range(9, 509).select(F.col("id").cast("string").alias("review_id"))
    assert rows(quality.overlap(left, right, "review_id")) == [(491, 9, 9, 98.2)]


def test_partitioning_does_not_change_results(spark):
    from reviewatlas.plans import registry

    names = ["estimated_impact", "match_competitors", "better_alternatives", "bursts", "dedup_tags"]
    seen = {}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for name in names:
            seen.setdefault(name, []).append(rows(registry.runner(name)(spark, "/root/testdata/sf0.001")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(a == b and a for a, b in seen.values())


def test_product_stats_makes_its_reviews_and_tags_once(spark, frame):
    """Reviews that are dear to make (a window each time) are made once, not for each aggregate."""
    def made(rows_, ddl):
        return keep_one(frame(rows_, ddl), ddl.split()[0], [F.col("parent_asin")])

    products = frame([("P", "P", 4.0, 1000, None, '{"5": 90, "1": 10}'), ("Q", "Q", None, None, 2, None)], PRODUCT)
    reviews = made([("r1", "P", "C", 5.0, None), ("r2", "P", "D", 1.0, None), ("r3", "Q", "Q", 3.0, None), (None, "Q", "Q", 2.0, None)], REVIEW)
    tags = made([("t1", "r1", "P", "soft", "Positive"), ("t2", "r2", "P", "soft", "Negative"), ("t3", None, "Q", "zip", None)], TAG)
    mapping = frame([("soft", "Softness", "Comfort")], MAPPING)
    whole = stats.product_stats(products, reviews, tags, mapping)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition(review_id") == 0
    got = {r.asin: r.asDict(recursive=True) for r in whole.collect()}
    assert [got[a]["kpis"]["total_reviews"] for a in "PQ"] == [1000, 2]
    one = stats.product_stats(products, reviews, tags, mapping, frame([("P",), ("P",)], "asin string")).collect()
    assert [r.asDict(recursive=True) for r in one] == [got["P"]]
