"""Aspect resolution and mention counts.

Tags are counted per (product, raw aspect) before the vocabulary is joined: the join then
moves one row per product and word instead of one per tag, and a word that a third of all
tags use arrives once per product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions.columns import norm
from reviewatlas.functions.frames import top_k

IS_POSITIVE = "sentiment = 'Positive'"
IS_NEGATIVE = "sentiment = 'Negative'"


def vocabulary_by(mapping: DataFrame, match: str) -> DataFrame:
    """One (standard, category) per key; keys that collide under norm take the smallest raw."""
    key = norm("raw_aspect") if match == "norm" else F.col("raw_aspect")
    best = F.min_by(F.struct("standard_aspect", "category"), F.col("raw_aspect"))
    return (
        mapping.filter(F.col("raw_aspect").isNotNull())
        .groupBy(key.alias("_key"))
        .agg(best.alias("_m"))
        .select("_key", F.col("_m.standard_aspect").alias("standard_aspect"), F.col("_m.category").alias("std_category"))
    )


def resolve_aspects(df: DataFrame, mapping: DataFrame, match: str = "exact", raw: str = "raw_aspect") -> DataFrame:
    """Add ``aspect`` (standard, else raw), ``standard_aspect`` and ``std_category``."""
    if match not in ("exact", "norm"):
        raise ValueError(f"match is 'exact' or 'norm', not {match!r}")
    key = norm(raw) if match == "norm" else F.col(raw)
    return (
        df.join(vocabulary_by(mapping, match), key == F.col("_key"), "left")
        .drop("_key")
        .withColumn("aspect", F.coalesce("standard_aspect", raw))
    )


def aspect_counts(tags: DataFrame, mapping: DataFrame, match: str = "exact") -> DataFrame:
    """(parent_asin, aspect, mentions, positive, negative)."""
    raw = (
        tags.groupBy("parent_asin", F.col("aspect").alias("raw_aspect"))
        .agg(
            F.count("*").alias("mentions"),
            F.expr(f"count_if({IS_POSITIVE})").alias("positive"),
            F.expr(f"count_if({IS_NEGATIVE})").alias("negative"),
        )
    )
    return resolved_counts(raw, mapping, match)


def resolved_counts(raw: DataFrame, mapping: DataFrame, match: str = "exact") -> DataFrame:
    """Counts per (family, raw aspect) as counts per (family, aspect)."""
    return (
        resolve_aspects(raw, mapping, match)
        .groupBy("parent_asin", "aspect")
        .agg(*[F.sum(c).alias(c) for c in ("mentions", "positive", "negative")])
    )


def aspect_mentions(tags: DataFrame, mapping: DataFrame, match: str = "exact", min_n: int = 2, k: int = 15) -> DataFrame:
    """Top aspects of every product by positive + negative mentions."""
    return top_mentions(aspect_counts(tags, mapping, match), min_n, k)


def top_mentions(counts: DataFrame, min_n: int = 2, k: int = 15) -> DataFrame:
    total = F.col("positive") + F.col("negative")
    return top_k(counts.filter(total >= min_n).drop("mentions"), "parent_asin", [total.desc(), F.asc("aspect")], k)


def top_aspects(tags: DataFrame, mapping: DataFrame, sentiment: str, match: str = "exact", k: int = 3) -> DataFrame:
    """Most frequent aspects of one sentiment per product, with their rank."""
    kept = tags.filter(F.col("sentiment") == sentiment)
    counts = aspect_counts(kept, mapping, match).select("parent_asin", "aspect", F.col("mentions").alias("cnt"))
    return top_k(counts, "parent_asin", [F.desc("cnt"), F.asc("aspect")], k, rank="rank")


def positive_ratio(digits: int | None = 1) -> Column:
    ratio = F.col("positive") * 100.0 / F.col("mentions")
    return ratio if digits is None else F.round(ratio, digits)


def aspect_sentiment(tags: DataFrame, mapping: DataFrame, match: str = "norm", min_n: int = 3) -> DataFrame:
    """Mentions and share of positive mentions per aspect."""
    counts = aspect_counts(tags, mapping, match).filter(F.col("mentions") >= min_n)
    return counts.withColumn("pos_ratio", positive_ratio())


def vocabulary(mapping: DataFrame) -> DataFrame:
    return (
        mapping.filter(F.col("standard_aspect") != "").select("standard_aspect").distinct()
        .orderBy("standard_aspect")
    )


def unmapped(tags: DataFrame, mapping: DataFrame, lo: int = 2, hi: int = 100, numeric: bool = False) -> DataFrame:
    """Raw aspects without a mapping and how often each occurs."""
    size = F.length("aspect")
    counts = tags.groupBy("aspect").agg(F.count("*").alias("mentions")).filter(size.between(lo, hi))
    if not numeric:
        counts = counts.filter(~F.col("aspect").rlike("^[0-9]+$"))
    known = mapping.filter(F.col("raw_aspect").isNotNull()).select(norm("raw_aspect").alias("_key")).distinct()
    return counts.join(known, norm("aspect") == F.col("_key"), "left_anti")


def unmapped_aspects(tags: DataFrame, mapping: DataFrame, lo: int = 2, hi: int = 100) -> DataFrame:
    return unmapped(tags, mapping, lo, hi).select(norm("aspect").alias("aspect")).distinct()


def top_unmapped(tags: DataFrame, mapping: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent unmapped aspects shorter than 50 characters."""
    counts = unmapped(tags, mapping, 0, 49, numeric=True)
    return counts.orderBy(F.desc("mentions"), F.asc("aspect")).limit(k)


def stars(tags: DataFrame, reviews: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Tags with the rounded star of their review."""
    rated = reviews.select("review_id", F.round("rating_score").cast("int").alias("star"))
    return tags.select("review_id", "parent_asin", "aspect", "sentiment", *columns).join(rated, "review_id")
