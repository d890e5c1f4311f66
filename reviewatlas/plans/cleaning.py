"""Registered queries: raw records to canonical rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.functions import columns as C
from reviewatlas.functions.frames import flatten_structs, lower_names
from reviewatlas.operators import clean
from reviewatlas.plans.raws import raw_products, raw_reviews
from reviewatlas.plans.registry import query

REVIEW_COLUMNS = [
    "review_id", "parent_asin", "child_asin", "variation_text", "author_name", "rating_score", "review_date",
    "is_verified", "vine_program", "helpful_count", "mining_status", "title", "text",
]


def shown(reviews):
    """The columns that are compared, long texts by their digest."""
    return reviews.select(*REVIEW_COLUMNS).withColumn("text", F.md5("text"))


@query("clean_reviews", "SELECT * FROM clean_reviews", ["clean_reviews"])
def _(t):
    return shown(clean.clean_reviews(raw_reviews(t)))


# first occurrence only, as the cleaner does
_BRAND = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'Visit the ', ''), ' Store', ''),"
    r" 'Brand: ', ''), '(?i)^by\s+', ''), '\s*\((Author|Producer|Creator|Contributor|Illustrator)\)', ''))"
)


@query("clean_products", f"""
    SELECT coalesce(url_id, asin) AS asin, parentAsin AS parent_asin, title, {_BRAND.format('manufacturer')} AS brand, mainImageUrl AS image_url,
      TRY_CAST(regexp_extract(productRating, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS real_average_rating, countReview AS real_total_ratings,
      CAST(NULL AS VARCHAR) AS main_niche, 'tumbler' AS category
    FROM rp QUALIFY row_number() OVER (PARTITION BY coalesce(url_id, asin)
      ORDER BY parentAsin NULLS LAST, title NULLS LAST, manufacturer NULLS LAST, CAST(NULL AS VARCHAR), CAST(countReview AS VARCHAR), real_average_rating NULLS LAST, mainImageUrl NULLS LAST) = 1""", ["rp"])
def _(t):
    cols = ["asin", "parent_asin", "title", "brand", "image_url", "real_average_rating", "real_total_ratings", "main_niche", "category"]
    return clean.clean_products(raw_products(t).drop("brand")).select(*cols)


@query("clean_products_with_hint", """
    SELECT coalesce(url_id, asin) AS asin, title, brand IS NULL AS bare, 'comforter' AS category FROM rp
    QUALIFY row_number() OVER (PARTITION BY coalesce(url_id, asin) ORDER BY parentAsin NULLS LAST, title NULLS LAST, brand NULLS LAST) = 1""", ["rp"])
def _(t):
    out = clean.clean_products(raw_products(t), hint="comforter")
    return out.select("asin", "title", F.col("brand").isNull().alias("bare"), "category")


# four files of a delivery: only two hold titles with a telling word, only one lacks every value of a column
_FILE = "IF(seq % 9 IN (1, 2), seq % 9, 3 + seq % 2)"
_FILE_SQL = "CASE WHEN seq % 9 IN (1, 2) THEN seq % 9 ELSE 3 + seq % 2 END"


def _delivery(t):
    """Records of several files; the last file speaks of books."""
    raw = raw_products(t).withColumn("file", F.expr(_FILE).cast("string"))
    title = F.when(F.col("file") == "4", F.concat("title", F.lit(" Notebook"))).when(F.col("file") == "2", F.lit("Soft comforter")).otherwise(F.col("title"))
    return raw.withColumn("title", title)


_VOTES = f"""SELECT file, CASE WHEN bool_or(lower(name) LIKE '%book%' OR lower(name) LIKE '%drawing%') THEN 'book'
      WHEN bool_or(lower(name) LIKE '%tumbler%' OR lower(name) LIKE '%bottle%') THEN 'tumbler' ELSE 'comforter' END AS category
    FROM (SELECT file, CASE file WHEN 4 THEN title || ' Notebook' WHEN 2 THEN 'Soft comforter' ELSE title END AS name FROM (SELECT *, {_FILE_SQL} AS file FROM rp)) GROUP BY 1"""


@query("category_per_file", f"SELECT seq, category FROM (SELECT seq, {_FILE_SQL} AS file FROM rp) JOIN ({_VOTES}) USING (file)", ["rp"])
def _(t):
    return clean.with_category(_delivery(t), file="file").select("seq", "category")


@query("clean_products_of_many_files", f"""SELECT asin, category FROM (SELECT coalesce(url_id, asin) AS asin, category FROM (SELECT *, {_FILE_SQL} AS file FROM rp) JOIN ({_VOTES}) USING (file))
    WHERE asin IN (SELECT asin FROM (SELECT coalesce(url_id, asin) AS asin FROM rp) GROUP BY 1 HAVING count(*) = 1)""", ["rp"])
def _(t):
    raw = _delivery(t).drop("brand")
    alone = raw.groupBy(F.coalesce(C.url_id("url"), F.col("asin")).alias("asin")).agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return clean.clean_products(raw, file="file").select("asin", "category").join(alone, "asin", "left_semi")


@query("default_if_all_null", f"""SELECT seq, CASE WHEN file IN (1, 4) THEN 'fallback' WHEN seq % 2 = 0 THEN parentAsin END AS filled, parentAsin AS kept
    FROM (SELECT seq, parentAsin, {_FILE_SQL} AS file FROM rp)""", ["rp"])
def _(t):
    raw = raw_products(t).withColumn("file", F.expr(_FILE)).withColumn("filled", F.when((F.col("file") != 1) & (F.col("seq") % 2 == 0), F.col("parentAsin")))
    rows = raw.select("seq", "file", "filled", F.col("parentAsin").alias("kept"))
    out = clean.default_if_all_null(clean.default_if_all_null(rows, "filled", F.lit("fallback"), "file"), "kept", F.lit("x"), "file")
    return out.drop("file")


_FAMILY = """
    SELECT seq, coalesce(body, url_id) AS child, coalesce(url_id, body) AS parent, body AS scraped, coalesce(url_id, parentAsin, body) AS requested_parent
    FROM rp"""


@query("resolve_family", _FAMILY, ["rp"])
def _(t):
    child, parent = C.resolve_family("url", "asin")
    scraped, requested = C.resolve_family("url", "asin", "parentAsin")
    return raw_products(t).select(
        "seq", child.alias("child"), parent.alias("parent"), scraped.alias("scraped"), requested.alias("requested_parent")
    )


@query("brand_variants", f"""
    SELECT seq, {_BRAND.format('manufacturer')} AS catalogue,
      trim(replace(replace(replace(replace(manufacturer, 'Brand: ', ''), 'Visit the ', ''), ' Store', ''), chr(8206), '')) AS detail,
      CASE WHEN contains(manufacturer, 'N/A') THEN 'N/A' ELSE trim(split_part(replace(manufacturer, 'by ', ''), '(', 1)) END AS credit,
      CASE WHEN p2 LIKE '% Store' THEN replace(p2, ' Store', '') ELSE p2 END AS prefix
    FROM (SELECT *, CASE WHEN p1 LIKE 'Visit the %' THEN replace(p1, 'Visit the ', '') ELSE p1 END AS p2
          FROM (SELECT *, CASE WHEN manufacturer LIKE 'Brand: %' THEN replace(manufacturer, 'Brand: ', '') ELSE manufacturer END AS p1 FROM rp))""", ["rp"])
def _(t):
    return raw_products(t).select("seq", *[C.clean_brand("manufacturer", m).alias(m) for m in ("catalogue", "detail", "credit", "prefix")])


@query("clean_metadata", """
    SELECT coalesce(body, url_id) AS asin, coalesce(url_id, body) AS parent_asin, title, imageUrlList[1] AS image_url,
      TRY_CAST(regexp_extract(productRating, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS real_average_rating, countReview AS real_total_ratings,
      w1 || ' | ' || w1 || ' | ' || w2 AS material, p_type AS design_type, aud AS target_audience, CAST(p_size AS VARCHAR) AS size_capacity,
      CAST(NULL AS VARCHAR) AS num_pieces, CAST(NULL AS VARCHAR) AS pack, p_brand AS brand
    FROM rp WHERE statusCode = 200 AND title <> '' AND coalesce(body, url_id) IS NOT NULL""", ["rp"])
def _(t):
    return clean.clean_metadata(raw_products(t))


CTE_DETAIL = """
    SELECT seq, body AS asin, coalesce(url_id, parentAsin, body) AS parent_asin, nullif(title, '') AS title,
      trim(replace(replace(replace(replace(coalesce(brand, manufacturer, p_brand), 'Brand: ', ''), 'Visit the ', ''), ' Store', ''), chr(8206), '')) AS brand,
      w1 AS material0, p_type AS design_type, CASE WHEN seq % 4 = 1 THEN '' ELSE aud END AS aud0, gen AS gender,
      CASE WHEN mainImageUrl IS NOT NULL THEN mainImageUrl ELSE imageUrlList[1] END AS image_url,
      CASE WHEN length(breadCrumbs) > 0 THEN w2 WHEN lastCategory IS NOT NULL THEN lastCategory ELSE 'Unknown' END AS main_niche
    FROM rp WHERE coalesce(url_id, parentAsin, body) IS NOT NULL"""


@query("clean_details", f"""
    SELECT asin, parent_asin, title, brand, material0 AS material, design_type,
      CASE WHEN coalesce(aud0, '') = '' AND (lower(title) LIKE '%kids%' OR lower(title) LIKE '%children%' OR lower(title) LIKE '%toddler%') THEN 'Kids' ELSE aud0 END AS target_audience,
      gender, image_url, main_niche, seq AS _seq FROM ({CTE_DETAIL})""", ["rp"])
def _(t):
    return clean.clean_details(raw_products(t), "book", "seq")


@query("clean_details_other_names", f"""
    SELECT seq AS _seq, CASE WHEN seq % 2 = 0 THEN 'Kids book' ELSE nullif(title, '') END AS title, CASE WHEN mainImageUrl IS NOT NULL THEN mainImageUrl ELSE imageUrlList[1] END AS image_url,
      CASE WHEN coalesce(CASE WHEN seq % 4 = 1 THEN '' ELSE aud END, '') = '' AND (seq % 2 = 0 OR lower(title) LIKE '%kids%') THEN 'Kids' WHEN seq % 4 = 1 THEN '' ELSE aud END AS target_audience
    FROM rp WHERE coalesce(url_id, parentAsin, body) IS NOT NULL""", ["rp"])
def _(t):
    even = F.col("seq") % 2 == 0
    raw = raw_products(t).withColumns({"title": F.when(even, "").otherwise(F.col("title")), "productTitle": F.when(even, "Kids book"), "mainImage": F.col("mainImage.imageUrl")})
    return clean.clean_details(raw, "book", "seq").select("_seq", "title", "image_url", "target_audience")


@query("clean_backfill", """
    SELECT asin, asin AS parent_asin, coalesce(title, '') AS title,
      CASE WHEN contains(coalesce(manufacturer, 'N/A'), 'N/A') THEN 'N/A' ELSE trim(split_part(replace(manufacturer, 'by ', ''), '(', 1)) END AS brand,
      imageUrlList[1] AS image_url, CASE WHEN lower(title) LIKE '%draw%' OR lower(title) LIKE '%book%' THEN 'book' ELSE 'comforter' END AS category,
      CASE WHEN lower(title) LIKE '%how to draw%' THEN 'How to Draw' END AS niche,
      coalesce(TRY_CAST(split_part(coalesce(productRating, '0'), ' ', 1) AS DOUBLE), 0) AS real_average_rating, coalesce(countReview, 0) AS real_total_ratings
    FROM rp WHERE statusCode = 200 AND asin <> ''""", ["rp"])
def _(t):
    return clean.clean_backfill(raw_products(t))


@query("fill_by_category", """
    SELECT seq, CASE WHEN material IS NULL AND (lower(title) LIKE '%stainless%' OR lower(title) LIKE '%steel%' OR lower(title) LIKE '%insulated%')
      THEN 'Stainless Steel' ELSE material END AS material FROM (SELECT seq, title, CASE WHEN seq % 2 = 0 THEN w1 END AS material FROM rp)""", ["rp"])
def _(t):
    rows = raw_products(t).select("seq", "title", F.when(F.col("seq") % 2 == 0, F.col("productDetails")[0]["value"]).alias("material"))
    return clean.fill_by_category(rows, "tumbler").select("seq", "material")


@query("niche_and_image", """
    SELECT seq, CASE WHEN length(breadCrumbs) > 0 THEN w2 WHEN lastCategory IS NOT NULL THEN lastCategory ELSE 'Unknown' END AS niche,
      CASE WHEN mainImageUrl IS NOT NULL THEN mainImageUrl ELSE imageUrlList[1] END AS image FROM rp""", ["rp"])
def _(t):
    return raw_products(t).select(
        "seq", C.niche_from_path("breadCrumbs", "categoriesExtended").alias("niche"), C.first_image("mainImage", "imageUrlList").alias("image")
    )


@query("build_breakdown", """
    SELECT id AS asin, arg_max(doc, seq) AS rating_breakdown FROM (
      SELECT seq, coalesce(nullif(asin, ''), parentAsin) AS id,
        '{"5":' || CAST(five AS DOUBLE) || ',"4":' || CAST(four AS DOUBLE) || ',"3":' || CAST(TRY_CAST(three AS DOUBLE) AS VARCHAR) || ',"2":0.0,"1":0.0}' AS doc
      FROM rp) WHERE id IS NOT NULL AND doc IS NOT NULL GROUP BY 1""", ["rp"])
def _(t):
    raw = raw_products(t)
    for word in ("five", "four", "three"):
        raw = raw.withColumnRenamed(word, f"reviewSummary/{word}Star/percentage")
    return clean.build_breakdown(raw, "seq")


@query("breakdown_values", """SELECT asin, CASE WHEN NOT missing THEN bsum END AS total, CASE WHEN NOT missing THEN b1 END AS one,
    CASE WHEN NOT missing THEN CAST(b1 AS VARCHAR) END AS path_one FROM
    (SELECT asin, missing, bsum, CAST(b1 AS BIGINT) AS b1 FROM bd)""", ["bd"])
def _(t):
    bd = C.breakdown_map("rating_breakdown")
    return t.products.select(
        "asin", C.map_total(bd).alias("total"), F.when(bd.isNotNull(), C.star_value(bd, 1).cast("bigint")).alias("one"),
        F.get_json_object("rating_breakdown", "$.1").alias("path_one"),
    )


@query("flatten_names", "SELECT seq, mainImageUrl AS \"mainimage/imageurl\", statusCode AS statuscode FROM rp", ["rp"])
def _(t):
    raw = raw_products(t).select("seq", "mainImage", "statusCode")
    return lower_names(flatten_structs(raw))


@query("sentiment_rules", """
    SELECT review_id, CASE WHEN s >= 4 THEN 'Positive' WHEN s <= 2 THEN 'Negative' ELSE 'Neutral' END AS by_rating,
      CASE code WHEN 'Pos' THEN 'Positive' WHEN 'Neg' THEN 'Negative' ELSE 'Neutral' END AS by_code
    FROM (SELECT review_id, CASE WHEN helpful_count = 2 THEN 3 WHEN helpful_count = 3 THEN 3 ELSE rating_score END AS s,
            CASE _flag WHEN 'N' THEN 'Pos' WHEN 'R' THEN 'Neg' WHEN 'A' THEN 'Odd' END AS code FROM reviews)""", ["reviews"])
def _(t):
    rows = t._reviews
    score = F.when(F.col("helpful_count") == 2, 0.0).when(F.col("helpful_count") != 3, F.col("rating_score"))
    code = F.when(F.col("_flag") == "N", "Pos").when(F.col("_flag") == "R", "Neg").otherwise("Odd")
    return rows.select("review_id", C.sentiment_from_rating(score).alias("by_rating"), C.sentiment_from_code(code).alias("by_code"))


@query("prompt_records", """
    SELECT review_id, md5('ID: ' || review_id || chr(10) || 'Text: ' || replace(replace(text, '"', ''''), chr(10), ' ') || chr(10) || '---' || chr(10)) AS record,
      substr(CASE WHEN text IS NULL OR text = '' THEN 'N/A' ELSE text END, 1, 100) AS quote FROM reviews_text""", ["reviews_text"])
def _(t):
    return t.reviews_text.select("review_id", F.md5(C.prompt_record("review_id", "text")).alias("record"), C.quote("text").alias("quote"))


@query("product_labels", """
    SELECT asin, '[' || asin || '] ' || CASE WHEN length(title) > 25 THEN substr(title, 1, 25) || '...' ELSE title END || ' | ⭐'
      || printf('%.1f', real_average_rating) || ' (' || format('{:,}', real_total_ratings) || ')' AS label
    FROM (SELECT asin, title || ' of ' || category || ' make' AS title, real_average_rating, real_total_ratings FROM products)""", ["products"])
def _(t):
    title = F.concat("title", F.lit(" of "), "category", F.lit(" make"))
    return t.products.select("asin", C.product_label("asin", title, "real_average_rating", "real_total_ratings").alias("label"))


@query("primary_niche", "SELECT parent_asin, trim(split_part(niche, ',', 1)) AS primary_niche FROM product_parents", ["product_parents"])
def _(t):
    return t.product_parents.select("parent_asin", C.primary_niche("niche").alias("primary_niche"))


@query("scrape_plan", """
    SELECT asin, 'com' AS domainCode, 'recent' AS sortBy, s AS filterByStar, 10 AS maxPages
    FROM products, unnest(['one_star', 'two_star', 'three_star', 'four_star', 'five_star']) u(s)""", ["products"])
def _(t):
    return clean.scrape_plan(t.products)


@query("find_parent_asin", """
    SELECT page_id, nullif(regexp_extract(CASE WHEN page_id % 3 = 0 THEN html || '"parentAsin" : "B' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '"' ELSE html END,
      '"parentAsin"\\s*:\\s*"(B[A-Z0-9]{9})"', 1), '') AS parent FROM pages""")
def _(t):
    planted = F.concat("html", F.lit('"parentAsin" : "B'), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit('"'))
    pages = t.raw("pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, planted).otherwise(F.col("html")))
    return clean.find_parent_asin(pages).select("page_id", "parent")


@query("valid_products", "SELECT asin FROM raw_products WHERE length(asin) > 0", ["raw_products"])
def _(t):
    return clean.valid_products(raw_products(t)).select("asin")
