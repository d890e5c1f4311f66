"""Raw scrape records written from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.plans.fixtures import CTES, REVIEW_TEXT, Tables


def asin(key: F.Column) -> F.Column:
    return F.concat(F.lit("A"), F.lpad(key.cast("string"), 9, "0"))


def raw_reviews(t: Tables) -> DataFrame:
    """Review records as scraped: everything is text, with planted gaps."""
    r = t._with_text(t.reviews_raw, "text", F.col("text"))
    ok = F.col("_ok")
    return r.select(
        F.when(ok % 97 != 0, F.col("review_id")).alias("reviewId"),
        F.col("parent_asin").alias("asin"), F.col("child_asin").alias("variationId"),
        F.col("author_name").alias("userName"),
        F.when(ok % 41 != 0, F.format_string("%.1f out of 5 stars", "rating_score")).alias("rating"),
        F.when(ok % 89 == 0, "no date").otherwise(
            F.concat(F.lit("Reviewed in the United States on "), F.date_format("review_date", "MMMM d, yyyy"))
        ).alias("date"),
        F.when(ok % 5 == 0, F.lit(None)).when(F.col("is_verified"), "TRUE").otherwise("false").alias("verified"),
        F.when(ok % 7 == 0, "True").when(ok % 7 == 1, "0").alias("vine"),
        F.when(ok % 3 == 0, F.lit(None)).when(ok % 31 == 1, "many").otherwise(F.col("helpful_count").cast("string")).alias("numberOfHelpful"),
        F.array("variation_text").alias("variationList"),
        F.when(ok % 43 != 0, F.concat(F.lit("Said \""), "variation_text", F.lit("\"\n"))).alias("title"), "text",
    )


CTES["raw_reviews"] = (["reviews_raw"], f"""
    SELECT CASE WHEN _ok % 97 <> 0 THEN review_id END AS reviewId, parent_asin AS asin, child_asin AS variationId, author_name AS userName,
      CASE WHEN _ok % 41 <> 0 THEN printf('%.1f out of 5 stars', rating_score) END AS rating,
      CASE WHEN _ok % 89 = 0 THEN 'no date' ELSE 'Reviewed in the United States on ' || strftime(review_date, '%B %-d, %Y') END AS "date",
      CASE WHEN _ok % 5 = 0 THEN NULL WHEN is_verified THEN 'TRUE' ELSE 'false' END AS verified,
      CASE WHEN _ok % 7 = 0 THEN 'True' WHEN _ok % 7 = 1 THEN '0' END AS vine,
      CASE WHEN _ok % 3 = 0 THEN NULL WHEN _ok % 31 = 1 THEN 'many' ELSE CAST(helpful_count AS VARCHAR) END AS numberOfHelpful,
      variation_text, CASE WHEN _ok % 43 <> 0 THEN 'Said "' || variation_text || '"' || chr(10) END AS title, {REVIEW_TEXT} AS text
    FROM reviews_raw LEFT JOIN documents d ON d.doc_id = _ok % (SELECT count(*) FROM documents)""")
CTES["clean_reviews"] = (["raw_reviews"], r"""
    SELECT * FROM (SELECT reviewId AS review_id, asin AS parent_asin, variationId AS child_asin, variation_text, userName AS author_name,
        coalesce(TRY_CAST(regexp_extract(rating, '(\d+\.?\d*)', 1) AS DOUBLE), 0) AS rating_score,
        CAST(try_strptime(trim(regexp_replace("date", '^.*on ', '')), '%B %d, %Y') AS DATE) AS review_date,
        coalesce(lower(verified) = 'true', false) AS is_verified, coalesce(lower(vine) = 'true', false) AS vine_program,
        TRY_CAST(coalesce(numberOfHelpful, '0') AS INTEGER) AS helpful_count, 'PENDING' AS mining_status, title, md5(text) AS text FROM raw_reviews)
    WHERE review_id IS NOT NULL AND review_date IS NOT NULL""")

_BRANDS = ["Visit the {} Store", "Brand: {}", "by {} (Author)", "{}‎", "{} Store by Co"]


def raw_products(t: Tables) -> DataFrame:
    """Product records as scraped: nested, decorated, incomplete."""
    p = F.col("p_partkey")
    name = F.col("p_brand")
    parts = [b.split("{}") for b in _BRANDS]
    brand = F.when(p % 6 == 5, F.lit(None).cast("string"))
    for i, (before, after) in enumerate(parts):
        brand = brand.when(p % 6 == i, F.concat(F.lit(before), name, F.lit(after)))
    words = F.split("p_name", " ")

    def pair(n: str, v) -> F.Column:
        return F.struct(F.lit(n).alias("name"), v.alias("value"))

    details = F.array(
        pair("Material Composition ‏ : ‎", words[0]),
        pair("Style Name", F.col("p_type")),
        pair("Target Audience", F.when(p % 4 == 0, "Kids").when(p % 4 == 1, "")),
        pair("Item Size", F.col("p_size").cast("string")),
        pair("Brand Name", name),
        pair("Fabric Type", words[1]),
        pair("Gender", F.when(p % 8 == 0, "Unisex")),
    )
    return t.raw("part").select(
        p.alias("seq"),
        F.when(p % 17 != 0, F.concat(F.lit("https://shop.example/x/dp/"), asin(p - p % 5), F.lit("?th=1"))).alias("url"),
        F.when(p % 19 != 0, asin(p)).otherwise("").alias("asin"),
        F.when(p % 3 != 0, asin(p - p % 10)).alias("parentAsin"),
        F.when(p % 29 != 0, F.concat(F.col("p_name"), F.when(p % 9 == 1, " steel kids tumbler").when(p % 9 == 2, " how to Draw").otherwise(""))).alias("title"),
        F.when(p % 5 == 3, F.concat(F.lit("Brand: "), name)).alias("brand"),
        brand.alias("manufacturer"),
        F.when(p % 11 != 0, F.format_string("%.1f out of 5 stars", 1.0 + (p * 7 % 41) / 10.0)).alias("productRating"),
        (p * 37 % 1000).alias("countReview"),
        F.when(p % 13 == 0, 404).otherwise(200).alias("statusCode"),
        F.when(p % 4 != 3, F.array(F.format_string("http://img.example/%d/a.jpg", p), F.lit("b.jpg"))).alias("imageUrlList"),
        F.when(p % 4 != 2, F.struct(F.format_string("http://img.example/%d/m.jpg", p).alias("imageUrl"))).alias("mainImage"),
        details.alias("productDetails"),
        F.when(p % 3 == 0, F.concat(F.lit("Home > Decor > "), words[1], F.lit(" "))).when(p % 3 == 1, "").alias("breadCrumbs"),
        F.when(p % 6 < 4, F.array(F.struct(F.lit("Top").alias("name")), F.struct(words[1].alias("name")))).alias("categoriesExtended"),
        (40 + p % 20).cast("string").alias("five"), F.when(p % 23 != 0, "20").alias("four"),
        F.when(p % 37 == 0, "n/a").otherwise("10").alias("three"),
    )


_A = "'A' || lpad(CAST({} AS VARCHAR), 9, '0')"
CTES["raw_products"] = ([], f"""
    SELECT p_partkey AS seq, CASE WHEN p_partkey % 17 <> 0 THEN 'https://shop.example/x/dp/' || {_A.format('p_partkey - p_partkey % 5')} || '?th=1' END AS url,
      CASE WHEN p_partkey % 19 <> 0 THEN {_A.format('p_partkey')} ELSE '' END AS asin,
      CASE WHEN p_partkey % 3 <> 0 THEN {_A.format('p_partkey - p_partkey % 10')} END AS parentAsin,
      CASE WHEN p_partkey % 29 <> 0 THEN p_name || CASE p_partkey % 9 WHEN 1 THEN ' steel kids tumbler' WHEN 2 THEN ' how to Draw' ELSE '' END END AS title,
      CASE WHEN p_partkey % 5 = 3 THEN 'Brand: ' || p_brand END AS brand,
      CASE p_partkey % 6 WHEN 0 THEN 'Visit the ' || p_brand || ' Store' WHEN 1 THEN 'Brand: ' || p_brand WHEN 2 THEN 'by ' || p_brand || ' (Author)'
        WHEN 3 THEN p_brand || chr(8206) WHEN 4 THEN p_brand || ' Store by Co' END AS manufacturer,
      CASE WHEN p_partkey % 11 <> 0 THEN printf('%.1f out of 5 stars', 1.0::DOUBLE + (p_partkey * 7 % 41) / 10.0::DOUBLE) END AS productRating,
      p_partkey * 37 % 1000 AS countReview, CASE WHEN p_partkey % 13 = 0 THEN 404 ELSE 200 END AS statusCode,
      CASE WHEN p_partkey % 4 <> 3 THEN ['http://img.example/' || p_partkey || '/a.jpg', 'b.jpg'] END AS imageUrlList,
      CASE WHEN p_partkey % 4 <> 2 THEN 'http://img.example/' || p_partkey || '/m.jpg' END AS mainImageUrl,
      split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_type, p_size, p_brand,
      CASE WHEN p_partkey % 4 = 0 THEN 'Kids' END AS aud, CASE WHEN p_partkey % 8 = 0 THEN 'Unisex' END AS gen,
      CASE WHEN p_partkey % 3 = 0 THEN 'Home > Decor > ' || split_part(p_name, ' ', 2) || ' ' WHEN p_partkey % 3 = 1 THEN '' END AS breadCrumbs,
      CASE WHEN p_partkey % 6 < 4 THEN split_part(p_name, ' ', 2) END AS lastCategory,
      CAST(40 + p_partkey % 20 AS VARCHAR) AS five, CASE WHEN p_partkey % 23 <> 0 THEN '20' END AS four,
      CASE WHEN p_partkey % 37 = 0 THEN 'n/a' ELSE '10' END AS three
    FROM part""")
CTES["rp"] = (["raw_products"], "SELECT *, nullif(regexp_extract(url, '/dp/([A-Z0-9]{10})', 1), '') AS url_id, nullif(asin, '') AS body FROM raw_products")
