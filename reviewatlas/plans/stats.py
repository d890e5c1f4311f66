"""Registered queries: product statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import aspects, quality, stats
from reviewatlas.plans.registry import query


@query("estimated_impact", "SELECT * FROM impact", ["impact"])
def _(t):
    return stats.estimated_impact(t.products, t.reviews, t.review_tags, t.aspect_mapping)


@query(
    "estimated_impact_top5",
    "SELECT * FROM impact_all QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY total_impact_vol DESC, net_impact DESC, aspect) <= 5",
    ["impact_all"],
)
def _(t):
    return stats.estimated_impact(t.products, t.reviews, t.review_tags, t.aspect_mapping, k=5)


@query(
    "product_kpis",
    "SELECT asin, total_reviews, round(avg_rating, 6) AS avg_rating, total_variations, round(neg_pct, 6) AS neg_pct, is_fallback FROM kpis",
    ["kpis"],
)
def _(t):
    k = stats.product_kpis(t.products, t.reviews)
    return k.withColumn("avg_rating", F.round("avg_rating", 6)).withColumn("neg_pct", F.round("neg_pct", 6))


@query("sample_kpis", """
    SELECT parent_asin, count(*) AS total_reviews, round(avg(rating_score), 6) AS avg_rating,
      count(DISTINCT child_asin) AS total_variations,
      round(count(*) FILTER (WHERE is_verified) * 100.0::DOUBLE / count(*), 6) AS verified_pct,
      round(count(*) FILTER (WHERE rating_score <= 2) * 100.0::DOUBLE / count(*), 6) AS negative_pct
    FROM reviews GROUP BY 1""", ["reviews"])
def _(t):
    k = stats.sample_kpis(t.reviews)
    for c in ("avg_rating", "verified_pct", "negative_pct"):
        k = k.withColumn(c, F.round(c, 6))
    return k


# star values with fractions, and some beyond the integers
_FRACTIONS = """'{"1": ' || CAST(CAST(substr(asin, 2) AS BIGINT) % 7 AS STRING) || '.6, "2": ' || CASE WHEN CAST(substr(asin, 2) AS BIGINT) % 10 = 5 THEN '1e12' ELSE '2.7' END || '}'"""


@query("live_kpis_of_fractions", f"""
    SELECT pp.parent_asin, CASE WHEN p.asin IS NULL OR CAST(substr(p.asin, 2) AS BIGINT) % 10 = 5 THEN 0 ELSE 1 + CAST(substr(p.asin, 2) AS BIGINT) % 7 + 3 END AS negative_pct
    FROM product_parents pp LEFT JOIN products p ON p.asin = pp.parent_asin""", ["product_parents", "products"])
def _(t):
    products = t.products.withColumn("rating_breakdown", F.expr(_FRACTIONS))
    return stats.live_kpis(t.product_parents, products).select("parent_asin", "negative_pct")


@query("live_kpis", """
    SELECT pp.parent_asin, CAST(coalesce(real_total_ratings, 0) AS BIGINT) AS total_reviews,
      coalesce(real_average_rating, 0) AS avg_rating, CAST(coalesce(variation_count, 0) AS BIGINT) AS total_variations,
      CAST(coalesce(b1 + b2, 0) AS BIGINT) AS negative_pct
    FROM product_parents pp LEFT JOIN products p ON p.asin = pp.parent_asin LEFT JOIN bd ON bd.asin = pp.parent_asin""",
    ["product_parents", "products", "bd"])
def _(t):
    return stats.live_kpis(t.product_parents, t.products)


def _mentions_sql(source: str, min_n: int, k: int) -> str:
    return f"""
    SELECT parent_asin, aspect, count(*) FILTER (WHERE sentiment = 'Positive') AS positive,
      count(*) FILTER (WHERE sentiment = 'Negative') AS negative
    FROM {source} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sentiment IN ('Positive', 'Negative')) >= {min_n}
    QUALIFY row_number() OVER (PARTITION BY parent_asin
      ORDER BY count(*) FILTER (WHERE sentiment IN ('Positive', 'Negative')) DESC, aspect) <= {k}"""


@query("aspect_mentions_engine", _mentions_sql("tags_exact", 2, 15), ["tags_exact"])
def _(t):
    return aspects.aspect_mentions(t.review_tags, t.aspect_mapping, "exact", 2, 15)


@query("aspect_mentions_live", _mentions_sql("tags_norm", 1, 10), ["tags_norm"])
def _(t):
    return aspects.aspect_mentions(t.review_tags, t.aspect_mapping, "norm", 1, 10)


@query("aspect_mentions_legacy", _mentions_sql("tags_exact", 2, 10), ["tags_exact"])
def _(t):
    return aspects.aspect_mentions(t.review_tags, t.aspect_mapping, "exact", 2, 10)


@query("weighted_scores", """
    SELECT parent_asin, aspect, round(score, 8) AS score, round(round(score, 8) * 100, 6) AS score_pct FROM (
      SELECT s.parent_asin, s.aspect,
        sum(rate * CASE star WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 WHEN 4 THEN b4 WHEN 5 THEN b5 ELSE 0 END / bsum) AS score
      FROM (SELECT t.parent_asin, t.aspect, CAST(round(rating_score) AS INTEGER) AS star,
              count(*) FILTER (WHERE sentiment = 'Positive')::DOUBLE / count(*) AS rate
            FROM tags_norm t JOIN reviews r USING (review_id) GROUP BY 1, 2, 3) s
      JOIN bd ON bd.asin = s.parent_asin AND bsum > 0 GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY round(score, 8), aspect) <= 15""",
    ["tags_norm", "reviews", "bd"])
def _(t):
    return stats.weighted_scores(t.products, t.reviews, t.review_tags, t.aspect_mapping)


@query("rating_trend", """
    SELECT parent_asin, CAST(date_trunc('month', review_date) AS DATE) AS month, round(avg(rating_score), 6) AS avg_score
    FROM reviews GROUP BY 1, 2""", ["reviews"])
def _(t):
    return stats.rating_trend(t.reviews).withColumn("avg_score", F.round("avg_score", 6))


@query("star_counts", "SELECT parent_asin, CAST(round(rating_score) AS INTEGER) AS star, count(*) AS cnt FROM reviews GROUP BY 1, 2", ["reviews"])
def _(t):
    return stats.star_counts(t.reviews)


@query("official_stars", """
    SELECT asin, star, value FROM (
      SELECT asin, 1 AS star, b1 AS value FROM bd WHERE NOT missing UNION ALL SELECT asin, 2, b2 FROM bd WHERE NOT missing
      UNION ALL SELECT asin, 3, b3 FROM bd WHERE NOT missing UNION ALL SELECT asin, 4, b4 FROM bd WHERE NOT missing
      UNION ALL SELECT asin, 5, b5 FROM bd WHERE NOT missing)""", ["bd"])
def _(t):
    return stats.official_stars(t.products)


def _top_sql(source: str, sentiment: str, k: int) -> str:
    return f"""
    SELECT * FROM (SELECT parent_asin, aspect, count(*) AS cnt,
        CAST(row_number() OVER (PARTITION BY parent_asin ORDER BY count(*) DESC, aspect) AS INTEGER) AS rank
      FROM {source} WHERE sentiment = '{sentiment}' GROUP BY 1, 2) WHERE rank <= {k}"""


@query("top_complaints", _top_sql("tags_exact", "Negative", 3), ["tags_exact"])
def _(t):
    return aspects.top_aspects(t.review_tags, t.aspect_mapping, "Negative", "exact", 3)


@query("top_complaints_10", _top_sql("tags_exact", "Negative", 10), ["tags_exact"])
def _(t):
    return aspects.top_aspects(t.review_tags, t.aspect_mapping, "Negative", "exact", 10)


@query("top_strengths", _top_sql("tags_norm", "Positive", 5), ["tags_norm"])
def _(t):
    return aspects.top_aspects(t.review_tags, t.aspect_mapping, "Positive", "norm", 5)


@query("aspect_sentiment", """
    SELECT parent_asin, aspect, count(*) AS mentions, count(*) FILTER (WHERE sentiment = 'Positive') AS positive,
      count(*) FILTER (WHERE sentiment = 'Negative') AS negative,
      round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0::DOUBLE / count(*), 1) AS pos_ratio
    FROM tags_norm GROUP BY 1, 2 HAVING count(*) >= 3""", ["tags_norm"])
def _(t):
    return aspects.aspect_sentiment(t.review_tags, t.aspect_mapping)


@query("review_summary", "SELECT parent_asin, count(*) AS review_count, round(avg(rating_score), 2) AS avg_rating FROM reviews GROUP BY 1", ["reviews"])
def _(t):
    return stats.review_summary(t.reviews)


@query("review_probe", "SELECT parent_asin, count(*) AS reviews, max(review_date) AS last_date FROM reviews GROUP BY 1", ["reviews"])
def _(t):
    return stats.review_probe(t.reviews)


_DOCUMENT = """
    SELECT k.asin, total_reviews, round(avg_rating, 6) AS avg_rating, total_variations, round(neg_pct, 6) AS neg_pct,
      coalesce(raw_text, '') AS raw_text, coalesce(weighted_text, '') AS weighted_text, coalesce(trend_text, '') AS trend_text
    FROM kpis k
    LEFT JOIN (SELECT parent_asin, string_agg(aspect || ':' || positive || ':' || negative, '|' ORDER BY positive + negative DESC, aspect) AS raw_text
               FROM ({mentions}) GROUP BY 1) r ON r.parent_asin = k.asin
    LEFT JOIN (SELECT parent_asin, string_agg(aspect || ':' || est_positive || ':' || est_negative || ':' || net_impact || ':' || total_impact_vol, '|'
                 ORDER BY total_impact_vol DESC, net_impact DESC, aspect) AS weighted_text FROM impact GROUP BY 1) w ON w.parent_asin = k.asin
    LEFT JOIN (SELECT parent_asin, string_agg(month || ':' || CAST(round(score * 10000) AS BIGINT), '|' ORDER BY month) AS trend_text
               FROM (SELECT parent_asin, CAST(CAST(date_trunc('month', review_date) AS DATE) AS VARCHAR) AS month, avg(rating_score) AS score FROM reviews GROUP BY 1, 2) GROUP BY 1) m
      ON m.parent_asin = k.asin
    {where}"""


def _flat_document(doc):
    """The document's arrays as text, so that any engine can compare them."""
    def text(column, names):
        return F.coalesce(F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[e[n] for n in names])), "|"), F.lit(""))

    return doc.select(
        "asin", "kpis.total_reviews", F.round("kpis.avg_rating", 6).alias("avg_rating"), "kpis.total_variations",
        F.round("kpis.neg_pct", 6).alias("neg_pct"),
        text("sentiment_raw", ["aspect", "positive", "negative"]).alias("raw_text"),
        text("sentiment_weighted", ["aspect", "est_positive", "est_negative", "net_impact", "total_impact_vol"]).alias("weighted_text"),
        F.coalesce(F.array_join(F.transform("rating_trend", lambda e: F.concat_ws(
            ":", e["month"].cast("string"), F.round(e["avg_score"] * 10000).cast("bigint").cast("string"))), "|"), F.lit("")).alias("trend_text"),
    )


@query("metrics_document", _DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15), where=""), ["kpis", "tags_exact", "impact"])
def _(t):
    return _flat_document(stats.product_stats(t.products, t.reviews, t.review_tags, t.aspect_mapping))


_STALE = """
    SELECT DISTINCT r.parent_asin FROM reviews r
    LEFT JOIN (SELECT asin, CAST('2000-01-01' AS TIMESTAMP) AS last_updated FROM products
               WHERE asin = parent_asin AND CAST(substr(asin, 2) AS BIGINT) % 3 <> 0) ps ON r.parent_asin = ps.asin
    LEFT JOIN (SELECT parent_asin, max(created_at) AS newest FROM review_tags GROUP BY 1) rt ON rt.parent_asin = r.parent_asin
    WHERE r.mining_status = 'COMPLETED' AND (ps.last_updated IS NULL OR r.ingested_at >= ps.last_updated OR newest >= ps.last_updated)"""


def stored_stats(t):
    """Families whose statistics were computed before; the others never were."""
    known = t.products.filter("asin = parent_asin").filter(F.substring("asin", 2, 9).cast("bigint") % 3 != 0)
    return known.select("asin", F.to_timestamp_ntz(F.lit("2000-01-01")).alias("last_updated"))


@query("stale_products", _STALE, ["reviews", "products", "review_tags"])
def _(t):
    return quality.stale_products(t.reviews, stored_stats(t), t.review_tags)


@query("metrics_document_stale", _DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15), where=f"WHERE k.asin IN ({_STALE})"),
       ["kpis", "tags_exact", "impact", "review_tags"])
def _(t):
    stale = quality.stale_products(t.reviews, stored_stats(t), t.review_tags).withColumnRenamed("parent_asin", "asin")
    return _flat_document(stats.product_stats(t.products, t.reviews, t.review_tags, t.aspect_mapping, stale))


@query("metrics_document_by_category", _DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15),
       where="WHERE k.asin IN (SELECT parent_asin FROM product_parents WHERE category = 'PROMO')"),
       ["kpis", "tags_exact", "impact", "product_parents"])
def _(t):
    scope = t.product_parents.filter("category = 'PROMO'").select(F.col("parent_asin").alias("asin"))
    return _flat_document(stats.product_stats(t.products, t.reviews, t.review_tags, t.aspect_mapping, scope))
