"""Counts of the catalogue on all levels at once: grouping sets over category, niche and family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {7: "all", 3: "category", 1: "niche", 0: "family"}


def catalogue_levels(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per family, per niche of a category, per category and for all, in one pass.

    ``reviews`` are counted per product id first, so the grouping sets spread rows of products, not of reviews. A level's absent keys are
    null; ``level`` tells them from keys that are null themselves.
    """
    counted = reviews.groupBy(F.col("parent_asin").alias("asin")).agg(F.count("*").alias("_n"), F.sum("rating_score").alias("_score"))
    rows = products.select("asin", "category", F.col("main_niche").alias("niche"), "parent_asin", "real_total_ratings", "rating_breakdown").join(counted, "asin", "left")
    keys = [F.col(c) for c in ("category", "niche", "parent_asin")]
    n = F.sum("_n")
    sums = rows.groupingSets([[], keys[:1], keys[:2], keys], *keys).agg(
        F.grouping_id().cast("int").alias("_level"), F.count("*").alias("products"), F.count("real_total_ratings").alias("has_meta"), F.count("rating_breakdown").alias("has_breakdown"),
        F.coalesce(n, F.lit(0)).alias("reviews"), F.count("_n").alias("with_reviews"), (F.sum("_score") / n).alias("avg_rating"), F.sum("real_total_ratings").alias("total_ratings"),
    )
    name = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return sums.select(F.element_at(name, F.col("_level")).alias("level"), *[c for c in sums.columns if c != "_level"])
