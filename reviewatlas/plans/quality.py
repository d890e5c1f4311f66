"""Registered queries: audits and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import aspects, quality
from reviewatlas.plans.registry import query


@query("review_coverage", """
    SELECT category, asin, coalesce(n, 0) AS reviews_count, real_total_ratings, rating_breakdown FROM products p
    LEFT JOIN (SELECT parent_asin AS key, count(*) AS n FROM reviews GROUP BY 1) r ON r.key = p.asin""", ["products", "reviews"])
def _(t):
    return quality.review_coverage(t.products, t.reviews)


@query("coverage_by_category", """
    SELECT category, count(asin) AS cnt, count(real_total_ratings) AS has_meta,
      CAST(round(avg(coalesce(n, 0))) AS BIGINT) AS avg_rev, CAST(round(avg(real_total_ratings)) AS BIGINT) AS avg_meta
    FROM products p LEFT JOIN (SELECT parent_asin AS key, count(*) AS n FROM reviews GROUP BY 1) r ON r.key = p.asin GROUP BY 1""",
    ["products", "reviews"])
def _(t):
    return quality.coverage_by_category(t.products, t.reviews)


@query("first_per_category", """
    SELECT category, asin, coalesce(n, 0) AS reviews_count, real_total_ratings, rating_breakdown FROM products p
    LEFT JOIN (SELECT parent_asin AS key, count(*) AS n FROM reviews GROUP BY 1) r ON r.key = p.asin
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY asin) <= 3""", ["products", "reviews"])
def _(t):
    return quality.first_per_category(t.products, t.reviews)


@query("audit_products", """
    SELECT category, count(*) AS total_asins, count(rating_breakdown) AS have_breakdown,
      CAST(round(avg(real_total_ratings)) AS BIGINT) AS avg_ratings FROM products GROUP BY 1""", ["products"])
def _(t):
    return quality.audit_products(t.products)


@query("parents_by_category", "SELECT category, count(*) AS cnt FROM product_parents GROUP BY 1", ["product_parents"])
def _(t):
    return quality.parents_by_category(t.product_parents)


@query("suspicious_rounding", """
    SELECT asin, category, real_total_ratings, rating_breakdown FROM products
    WHERE real_total_ratings > 99 AND real_total_ratings % 100 = 0""", ["products"])
def _(t):
    return quality.suspicious_rounding(t.products)


@query("low_volume_sample", """
    SELECT asin, category, real_total_ratings, rating_breakdown FROM products
    WHERE real_total_ratings BETWEEN 1 AND 499 AND rating_breakdown IS NOT NULL ORDER BY md5(asin), asin LIMIT 5""", ["products"])
def _(t):
    return quality.low_volume_sample(t.products)


@query("pipeline_status", "SELECT mining_status, count(*) AS cnt FROM reviews GROUP BY 1", ["reviews"])
def _(t):
    return quality.pipeline_status(t.reviews)


_UNMAPPED = "FROM review_tags t WHERE lower(trim(t.aspect)) NOT IN (SELECT key FROM norm_mapping)"


@query("unmapped_debt", f"SELECT count(DISTINCT t.aspect) AS unmapped_count {_UNMAPPED} AND length(t.aspect) BETWEEN 2 AND 40",
       ["review_tags", "norm_mapping"])
def _(t):
    return quality.unmapped_debt(t.review_tags, t.aspect_mapping)


@query("unmapped_aspects", f"""SELECT DISTINCT lower(trim(t.aspect)) AS aspect {_UNMAPPED}
    AND length(t.aspect) BETWEEN 2 AND 100 AND NOT regexp_full_match(t.aspect, '[0-9]+')""", ["review_tags", "norm_mapping"])
def _(t):
    return aspects.unmapped_aspects(t.review_tags, t.aspect_mapping)


@query("top_unmapped", f"""SELECT t.aspect, count(*) AS mentions {_UNMAPPED} AND length(t.aspect) < 50
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""", ["review_tags", "norm_mapping"])
def _(t):
    return aspects.top_unmapped(t.review_tags, t.aspect_mapping)


@query("vocabulary", "SELECT DISTINCT standard_aspect FROM aspect_mapping WHERE standard_aspect <> ''", ["aspect_mapping"])
def _(t):
    return aspects.vocabulary(t.aspect_mapping)


@query("integrity_counters", """
    SELECT 'total_products' AS "check", count(*) AS cnt FROM products
    UNION ALL SELECT 'total_parents', count(*) FROM product_parents
    UNION ALL SELECT 'distinct_families', count(DISTINCT parent_asin) FROM products
    UNION ALL SELECT 'orphan_products', count(*) FROM products WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents)
    UNION ALL SELECT 'false_parents', count(*) FROM product_parents WHERE parent_asin IN (SELECT asin FROM products WHERE asin <> parent_asin)
    UNION ALL SELECT 'parents_without_reviews', count(*) FROM product_parents WHERE parent_asin NOT IN (SELECT parent_asin FROM reviews)""",
    ["products", "product_parents", "reviews"])
def _(t):
    return quality.integrity_counters(t.products, t.product_parents, t.reviews)


@query("missing_parents", """SELECT DISTINCT parent_asin FROM products WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents)
    AND parent_asin IN (SELECT asin FROM products WHERE asin = parent_asin)""", ["products", "product_parents"])
def _(t):
    return quality.missing_parents(t.products, t.product_parents)


@query("unscraped_parents", """SELECT parent_asin FROM product_parents
    WHERE parent_asin NOT IN (SELECT CASE WHEN parent_asin LIKE '%5' THEN 'X' ELSE parent_asin END FROM reviews)""", ["product_parents", "reviews"])
def _(t):
    return quality.unscraped_parents(t.product_parents, t.reviews.withColumn("parent_asin", F.expr("IF(parent_asin LIKE '%5', 'X', parent_asin)")))


@query("missing_metadata", """SELECT parent_asin FROM (SELECT parent_asin, CASE WHEN image_url IS NOT NULL THEN brand END AS brand FROM product_parents)
    WHERE brand IS NULL ORDER BY 1 LIMIT 20""", ["product_parents"])
def _(t):
    bare = t.product_parents.withColumn("brand", F.when(F.col("image_url").isNotNull(), F.col("brand")))
    return quality.missing_metadata(bare, 20)


@query("queue_pending", "SELECT * FROM queue WHERE status = 'PENDING_APPROVAL'", ["queue"])
def _(t):
    return quality.queue_view(t.scrape_queue, "PENDING_APPROVAL")


@query("queue_in_progress_50", "SELECT * FROM queue WHERE status = 'IN_PROGRESS' ORDER BY created_at DESC, request_id LIMIT 50", ["queue"])
def _(t):
    return quality.queue_view(t.scrape_queue, "IN_PROGRESS", 50)


_RANKED = """
    SELECT *, row_number() OVER (PARTITION BY review_id, quote, sentiment
      ORDER BY (std IS NOT NULL) DESC, created_at DESC, tag_id) AS rn
    FROM (SELECT q.*, m.standard_aspect AS std FROM review_tags_quoted q LEFT JOIN aspect_mapping m ON q.aspect = m.raw_aspect)"""


@query("dedup_tags", f"SELECT tag_id, review_id, parent_asin, category, aspect, sentiment, created_at, quote FROM ({_RANKED}) WHERE rn = 1",
       ["review_tags_quoted", "aspect_mapping"])
def _(t):
    return quality.dedup_tags(t.review_tags_quoted, t.aspect_mapping)


@query("dedup_stats", f"SELECT CASE WHEN rn = 1 THEN 'KEEP' ELSE 'DELETE' END AS action, count(*) AS cnt FROM ({_RANKED}) GROUP BY 1",
       ["review_tags_quoted", "aspect_mapping"])
def _(t):
    return quality.dedup_stats(t.review_tags_quoted)


_SIDES = """
    WITH l AS (SELECT DISTINCT CASE WHEN helpful_count = 1 THEN 'L' ELSE '' END || review_id AS review_id FROM reviews),
    r AS (SELECT DISTINCT CASE WHEN helpful_count = 2 THEN 'R' ELSE '' END || review_id AS review_id FROM reviews),
    f AS (SELECT coalesce(l.review_id, r.review_id) AS review_id, l.review_id IS NOT NULL AS il, r.review_id IS NOT NULL AS ir
          FROM l FULL JOIN r ON l.review_id = r.review_id) """


def _halves(t):
    """Two whole sources; each has ids that the other lacks."""
    return [t.reviews.withColumn("review_id", F.expr(f"IF(helpful_count = {n}, '{mark}', '') || review_id")) for n, mark in ((1, "L"), (2, "R"))]


@query("source_overlap", "SELECT * FROM (" + _SIDES + """
    SELECT count(*) FILTER (WHERE il AND ir) AS common, count(*) FILTER (WHERE il AND NOT ir) AS only_left,
      count(*) FILTER (WHERE ir AND NOT il) AS only_right,
      round(count(*) FILTER (WHERE il AND ir) * 100.0::DOUBLE / count(*) FILTER (WHERE il), 1) AS common_pct FROM f)""", ["reviews"])
def _(t):
    return quality.overlap(*_halves(t), "review_id")


@query("source_overlap_rows", "SELECT * FROM (" + _SIDES + "SELECT review_id, CASE WHEN il AND ir THEN 'both' WHEN il THEN 'left' ELSE 'right' END AS side FROM f)", ["reviews"])
def _(t):
    return quality.overlap_rows(*_halves(t), "review_id")


def older(products):
    """An earlier snapshot: some histograms were missing, some different."""
    key = F.substring("asin", 2, 9).cast("bigint")
    was = F.when(key % 7 == 0, F.lit(None)).when(key % 10 == 3, '{"5": 1}').when(key % 70 == 35, '{"4": 1}').otherwise(F.col("rating_breakdown"))
    return products.withColumn("rating_breakdown", was)


OLDER = """older AS (SELECT * REPLACE (CASE WHEN CAST(substr(asin, 2) AS BIGINT) % 7 = 0 THEN NULL
    WHEN CAST(substr(asin, 2) AS BIGINT) % 10 = 3 THEN '{"5": 1}' WHEN CAST(substr(asin, 2) AS BIGINT) % 70 = 35 THEN '{"4": 1}'
    ELSE rating_breakdown END AS rating_breakdown) FROM products)"""


@query("snapshot_diff", f"""SELECT * FROM (WITH {OLDER}
    SELECT p.asin, o.rating_breakdown AS old_value, p.rating_breakdown AS new_value, p.category,
      CASE WHEN o.rating_breakdown IS NOT NULL AND p.rating_breakdown IS NULL THEN 'lost'
           WHEN o.rating_breakdown IS NOT NULL AND p.rating_breakdown <> o.rating_breakdown THEN 'changed'
           WHEN o.rating_breakdown IS NULL AND p.rating_breakdown IS NOT NULL THEN 'gained' END AS change
    FROM products p JOIN older o ON o.asin = p.asin) WHERE change IS NOT NULL""", ["products"])
def _(t):
    return quality.snapshot_diff(older(t.products), t.products, "asin", "rating_breakdown", ["category"])


@query("category_summary", f"""SELECT * FROM (WITH {OLDER}
    SELECT * FROM (SELECT category, count(*) AS total_local, count(rating_breakdown) AS has_bd_local FROM products GROUP BY 1)
    JOIN (SELECT category, count(*) AS total_prod, count(rating_breakdown) AS has_bd_prod FROM older GROUP BY 1) USING (category))""", ["products"])
def _(t):
    return quality.category_summary(t.products, older(t.products))


@query("newly_filled", f"""SELECT * FROM (WITH {OLDER} SELECT asin, category, rating_breakdown FROM products
    WHERE rating_breakdown IS NOT NULL AND asin NOT IN (SELECT asin FROM older WHERE rating_breakdown IS NOT NULL))""", ["products"])
def _(t):
    return quality.newly_filled(t.products, older(t.products), "asin", "rating_breakdown").select("asin", "category", "rating_breakdown")


PHRASES = ["retitioning", "their", "laou", "xyzzy not there", "the of"]


@query("verify_phrases", " UNION ALL ".join(
    f"SELECT parent_asin, '{p}' AS phrase, count(*) FILTER (WHERE contains(lower(text), '{p}')) AS cnt,"
    f" count(*) FILTER (WHERE contains(lower(text), '{p}')) > 0 AS found FROM reviews_text GROUP BY 1"
    for p in PHRASES), ["reviews_text"])
def _(t):
    return quality.verify_phrases(t.reviews_text, PHRASES)


@query("mapped_rows", "SELECT count(*) AS cnt FROM review_tags WHERE aspect IN (SELECT raw_aspect FROM aspect_mapping)", ["review_tags", "aspect_mapping"])
def _(t):
    mapping = t.aspect_mapping.withColumnRenamed("raw_aspect", "aspect")
    return quality.mapped_rows(t.review_tags, mapping, "aspect")
