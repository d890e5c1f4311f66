"""Registered queries: merges, families, ingest and truth repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import linkage, upsert as up
from reviewatlas.operators.clean import clean_reviews
from reviewatlas.plans.raws import raw_products, raw_reviews
from reviewatlas.plans.registry import query
from reviewatlas.plans.cleaning import CTE_DETAIL, REVIEW_COLUMNS, _BRAND, shown

# --- merges: the catalogue against a derived delivery ---------------------------------------

_COLS = ["asin", "parent_asin", "title", "brand", "image_url", "category"]


def base(t):
    return t.products.select(*_COLS)


def delivery(t):
    """Two thirds of the catalogue under new titles, some values missing, and as many new ids."""
    key = F.substring("asin", 2, 9).cast("bigint")
    rows = base(t).filter(key % 3 != 0)
    changed = rows.select(
        "asin", "parent_asin", F.when(key % 4 != 0, F.concat("title", F.lit(" v2"))).alias("title"),
        F.when(key % 5 != 0, F.upper("brand")).alias("brand"), F.when(key % 7 != 0, F.lit("new.jpg")).alias("image_url"),
        F.when(key % 2 == 0, "PROMO").alias("category"),
    )
    return changed.unionByName(changed.withColumn("asin", F.concat(F.lit("N"), F.substring("asin", 2, 9))))


_D = """b AS (SELECT asin, parent_asin, title, brand, image_url, category FROM products),
    c AS (SELECT asin, parent_asin, CASE WHEN k % 4 <> 0 THEN title || ' v2' END AS title, CASE WHEN k % 5 <> 0 THEN upper(brand) END AS brand,
      CASE WHEN k % 7 <> 0 THEN 'new.jpg' END AS image_url, CASE WHEN k % 2 = 0 THEN 'PROMO' END AS category
      FROM (SELECT *, CAST(substr(asin, 2) AS BIGINT) AS k FROM b) WHERE k % 3 <> 0),
    d AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('N' || substr(asin, 2) AS asin) FROM c)"""


def _merged(rules: dict[str, str]) -> str:
    cols = ", ".join(
        f"CASE WHEN d.asin IS NULL THEN b.{c} WHEN b.asin IS NULL THEN d.{c} ELSE {rules.get(c, 'b.' + c)} END AS {c}" for c in _COLS[1:]
    )
    return f"SELECT * FROM (WITH {_D} SELECT coalesce(b.asin, d.asin) AS asin, {cols} FROM b FULL JOIN d ON b.asin = d.asin)"


@query("upsert_overwrite", _merged({c: f"d.{c}" for c in _COLS}), ["products"])
def _(t):
    return up.upsert(base(t), delivery(t), ["asin"], "overwrite")


@query("upsert_fill", _merged({c: f"coalesce(d.{c}, b.{c})" for c in _COLS}), ["products"])
def _(t):
    return up.upsert(base(t), delivery(t), ["asin"], "fill")


@query("upsert_mixed", _merged({"title": "d.title", "brand": "d.brand", "category": "coalesce(d.category, b.category)", "image_url": "coalesce(d.image_url, b.image_url)"}), ["products"])
def _(t):
    return up.upsert(base(t), delivery(t), ["asin"], {"title": "overwrite", "brand": "overwrite", "category": "fill", "image_url": "fill"})


@query("upsert_guarded", _merged({"category": "CASE WHEN b.category IS NULL OR b.category IN ('SMALL', 'LARGE') THEN d.category ELSE b.category END"}), ["products"])
def _(t):
    return up.upsert(base(t), delivery(t), ["asin"], {"category": up.guarded([None, "SMALL", "LARGE"])})


@query("insert_missing", f"SELECT * FROM (WITH {_D} SELECT * FROM b UNION ALL SELECT * FROM d WHERE asin NOT IN (SELECT asin FROM b))", ["products"])
def _(t):
    return up.insert_missing(base(t), delivery(t), ["asin"])


@query("insert_unseen_reviews", """
    SELECT * FROM (WITH s AS (SELECT CASE WHEN helpful_count > 3 THEN '' ELSE 'old' END || review_id AS review_id, rating_score, review_date FROM reviews)
    SELECT * FROM s
    UNION ALL SELECT * FROM (SELECT review_id, rating_score, review_date FROM reviews_raw WHERE review_id NOT IN (SELECT review_id FROM s)
      QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY rating_score, review_date) = 1))""", ["reviews"])
def _(t):
    cols = ["review_id", "rating_score", "review_date"]
    stored = t.reviews.withColumn("review_id", F.expr("IF(helpful_count > 3, '', 'old') || review_id")).select(*cols)
    return up.insert_missing(stored, t.reviews_raw.select(*cols), ["review_id"])


@query("replace_children", """
    SELECT * FROM (WITH f AS (SELECT review_id || '#n' AS tag_id, review_id, parent_asin, 'New' AS category, 'fresh' AS aspect, sentiment, created_at FROM review_tags
        WHERE tag_id LIKE '%5#1')
    SELECT tag_id, review_id, parent_asin, category, aspect, sentiment, created_at FROM review_tags WHERE review_id NOT IN (SELECT review_id FROM f) UNION ALL SELECT * FROM f)""", ["review_tags"])
def _(t):
    fresh = t.review_tags.filter(F.col("tag_id").endswith("5#1")).select(
        F.concat("review_id", F.lit("#n")).alias("tag_id"), "review_id", "parent_asin", F.lit("New").alias("category"),
        F.lit("fresh").alias("aspect"), "sentiment", "created_at",
    )
    return up.replace_children(t.review_tags, fresh, "review_id")


_MOVES = "moves AS (SELECT a AS old, b AS new FROM pairs WHERE CAST(substr(a, 2) AS BIGINT) % 20 = 0)"


def moves(t):
    return t.pairs.filter(F.substring("a", 2, 9).cast("bigint") % 20 == 0).select(F.col("a").alias("old"), F.col("b").alias("new"))


@query("relink_reviews", f"SELECT * FROM (WITH {_MOVES} SELECT review_id, coalesce(new, parent_asin) AS parent_asin FROM reviews LEFT JOIN moves ON old = parent_asin)", ["reviews", "pairs"])
def _(t):
    rows = t.reviews.select("review_id", "parent_asin")
    return up.relink(rows, moves(t).withColumnRenamed("old", "parent_asin"), "parent_asin", "new", "parent_asin")


@query("move_key_products", f"SELECT * FROM (WITH {_MOVES} SELECT asin, coalesce(new, parent_asin) AS parent_asin FROM products LEFT JOIN moves ON old = parent_asin)", ["products", "pairs"])
def _(t):
    rows = up.move_key(t.products.select("asin", "parent_asin"), t.reviews.select("review_id", "parent_asin"), t.product_parents, moves(t))
    return rows[0]


@query("move_key_parents", f"""SELECT * FROM (WITH {_MOVES},
    n AS (SELECT * FROM product_parents UNION ALL SELECT p.* REPLACE (new AS parent_asin) FROM product_parents p JOIN moves ON old = p.parent_asin
          WHERE new NOT IN (SELECT parent_asin FROM product_parents))
    SELECT * FROM n WHERE parent_asin NOT IN (SELECT old FROM moves))""", ["product_parents", "pairs"])
def _(t):
    return up.move_key(t.products.select("asin", "parent_asin"), t.reviews.select("review_id", "parent_asin"), t.product_parents, moves(t))[2]


@query("move_key_reviews", f"SELECT * FROM (WITH {_MOVES} SELECT review_id, coalesce(new, parent_asin) AS parent_asin FROM reviews LEFT JOIN moves ON old = parent_asin)", ["reviews", "pairs"])
def _(t):
    return up.move_key(t.products.select("asin", "parent_asin"), t.reviews.select("review_id", "parent_asin"), t.product_parents, moves(t))[1]


@query("update_where", "SELECT asin, CASE WHEN category = 'PROMO' AND real_total_ratings > 500 THEN 'HOT' ELSE category END AS category FROM products", ["products"])
def _(t):
    hot = (F.col("category") == "PROMO") & (F.col("real_total_ratings") > 500)
    return up.update_where(t.products, hot, category=F.lit("HOT")).select("asin", "category")


@query("retain_truth", "SELECT parent_asin, category FROM product_parents WHERE coalesce(category <> 'PROMO', true) OR parent_asin IN (SELECT a FROM pairs)", ["product_parents", "pairs"])
def _(t):
    truth = t.pairs.select(F.col("a").alias("parent_asin"))
    return up.retain_truth(t.product_parents, truth, "parent_asin", F.col("category") == "PROMO").select("parent_asin", "category")


@query("set_status", "SELECT review_id, CASE WHEN mining_status = 'PENDING' THEN 'QUEUED' ELSE mining_status END AS mining_status FROM reviews", ["reviews"])
def _(t):
    return up.set_status(t.reviews, t.reviews.filter("mining_status = 'PENDING'"), "review_id", "QUEUED").select("review_id", "mining_status")


@query("reset_status", "SELECT review_id, CASE WHEN mining_status = 'QUEUED' THEN 'PENDING' ELSE mining_status END AS mining_status FROM reviews", ["reviews"])
def _(t):
    return up.update_where(t.reviews, F.col("mining_status") == "QUEUED", mining_status=F.lit("PENDING")).select("review_id", "mining_status")


@query("advance_queue", """
    SELECT request_id, q.asin, CASE WHEN status = 'IN_PROGRESS' AND p.asin IS NOT NULL THEN CASE WHEN found THEN 'COMPLETED' ELSE 'FAILED' END ELSE status END AS status,
      requested_by, CASE WHEN status = 'IN_PROGRESS' AND p.asin IS NOT NULL THEN coalesce(note, '') || CASE WHEN found THEN ' [Found Parent: ' || parent_asin || ']' ELSE ' [Parent Not Found]' END ELSE note END AS note, created_at
    FROM queue q LEFT JOIN (SELECT asin, parent_asin, real_total_ratings IS NOT NULL AS found FROM (SELECT * REPLACE (CASE WHEN category = 'SMALL' THEN 'X' || asin ELSE asin END AS asin) FROM products)) p ON p.asin = q.asin""", ["queue", "products"])
def _(t):
    outcomes = t.products.select(
        F.expr("IF(category = 'SMALL', 'X', '') || asin").alias("asin"), F.when(F.col("real_total_ratings").isNotNull(), F.col("parent_asin")).alias("parent")
    )
    return up.advance_queue(t.scrape_queue, outcomes)


@query("latest_status", "SELECT parent_asin, arg_max(mining_status, review_id) AS status, max(review_id) AS review_id FROM reviews GROUP BY 1", ["reviews"])
def _(t):
    return up.latest_status(t.reviews.withColumnRenamed("mining_status", "status"), "parent_asin", "review_id")


# --- families --------------------------------------------------------------------------------


@query("niche_rollup", "SELECT * FROM niches", ["niches"])
def _(t):
    return linkage.niche_rollup(t.products)


@query("parent_lookup", """SELECT asin, parent_asin FROM products
    UNION ALL SELECT DISTINCT parent_asin, parent_asin FROM products WHERE parent_asin NOT IN (SELECT asin FROM products)""", ["products"])
def _(t):
    return linkage.parent_lookup(t.products)


@query("flag_multi_niche", """SELECT pp.* REPLACE (CASE WHEN parent_asin IN (SELECT parent_asin FROM products GROUP BY 1 HAVING count(DISTINCT main_niche) > 1)
    THEN 'Multi-Niche' ELSE niche END AS niche) FROM product_parents pp""", ["products", "product_parents"])
def _(t):
    return linkage.flag_multi_niche(t.product_parents, t.products)


_STORED = """stored AS (SELECT CASE WHEN helpful_count > 4 THEN '' ELSE 'old' END || review_id AS review_id FROM reviews),
    known AS (SELECT CASE WHEN category = 'LARGE' THEN 'X' ELSE '' END || asin AS asin, parent_asin FROM products)"""


def _link(t):
    raw = clean_reviews(raw_reviews(t)).select(*REVIEW_COLUMNS).withColumn("parent_asin", F.concat(F.lit("S"), F.substring("parent_asin", 2, 9)))
    # half of the history has other ids, and the large products are unknown under theirs
    stored = t.reviews.withColumn("review_id", F.expr("IF(helpful_count > 4, '', 'old') || review_id"))
    return linkage.link_reviews(raw, stored, t.products.withColumn("asin", F.expr("IF(category = 'LARGE', 'X', '') || asin")), t.product_parents)


_LINKED = f"""{_STORED}, l AS (SELECT r.* REPLACE (coalesce(k.parent_asin, 'S' || substr(r.parent_asin, 2)) AS parent_asin)
    FROM clean_reviews r LEFT JOIN known k ON k.asin = r.child_asin)"""


@query("link_reviews", f"""SELECT * FROM (WITH {_LINKED} SELECT * FROM l WHERE review_id NOT IN (SELECT review_id FROM stored)
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY {', '.join(c + ' NULLS LAST' for c in REVIEW_COLUMNS[1:])}) = 1)""",
       ["clean_reviews", "reviews", "products"])
def _(t):
    fresh, _ = _link(t)
    return shown(fresh)


@query("link_reviews_parents", f"""SELECT * FROM (WITH {_LINKED} SELECT DISTINCT parent_asin, 'unknown' AS category, 'Recovered Product: ' || parent_asin AS title,
    'Unknown' AS brand, 'UNCERTAIN' AS verification_status FROM l WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents))""",
       ["clean_reviews", "reviews", "products", "product_parents"])
def _(t):
    return _link(t)[1]


_BATCH = f"""batch AS (SELECT coalesce(url_id, asin) AS asin, parentAsin AS parent_asin, title, {_BRAND.format('manufacturer')} AS brand, mainImageUrl AS image_url,
      TRY_CAST(regexp_extract(productRating, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS real_average_rating, countReview AS real_total_ratings, 'tumbler' AS category
    FROM rp QUALIFY row_number() OVER (PARTITION BY coalesce(url_id, asin)
      ORDER BY parentAsin NULLS LAST, title NULLS LAST, manufacturer NULLS LAST, CAST(countReview AS VARCHAR), real_average_rating NULLS LAST, mainImageUrl NULLS LAST) = 1),
  heads AS (SELECT coalesce(parent_asin, asin) AS parent_asin, category, title, brand, image_url FROM batch
    QUALIFY row_number() OVER (PARTITION BY coalesce(parent_asin, asin) ORDER BY (asin = coalesce(parent_asin, asin)) DESC, asin) = 1),
  np AS (SELECT coalesce(p.asin, b.asin) AS asin, CASE WHEN p.asin IS NULL THEN coalesce(b.parent_asin, b.asin) ELSE p.parent_asin END AS parent_asin,
      coalesce(b.title, p.title) AS title, coalesce(b.brand, p.brand) AS brand, p.main_niche,
      CASE WHEN p.asin IS NULL THEN b.image_url ELSE p.image_url END AS image_url,
      CASE WHEN p.asin IS NULL THEN b.real_average_rating ELSE p.real_average_rating END AS real_average_rating,
      CASE WHEN p.asin IS NULL THEN b.real_total_ratings ELSE p.real_total_ratings END AS real_total_ratings,
      CASE WHEN p.asin IS NULL THEN b.category ELSE p.category END AS category
    FROM products p FULL JOIN batch b ON p.asin = b.asin)"""
_PCOLS = ["asin", "parent_asin", "title", "brand", "main_niche", "image_url", "real_average_rating", "real_total_ratings", "category"]


def _ingested(t):
    return linkage.ingest_products(raw_products(t).drop("brand"), t.products, t.product_parents)


@query("ingest_products", f"SELECT * FROM (WITH {_BATCH} SELECT * FROM np)", ["rp", "products"])
def _(t):
    return _ingested(t)[0].select(*_PCOLS)


@query("ingest_products_parents", f"""SELECT * FROM (WITH {_BATCH},
    roll AS (SELECT parent_asin, string_agg(main_niche, ', ' ORDER BY main_niche) AS niche FROM (SELECT DISTINCT parent_asin, main_niche FROM np WHERE main_niche IS NOT NULL AND main_niche <> 'unknown') GROUP BY 1)
    SELECT coalesce(p.parent_asin, h.parent_asin) AS parent_asin, coalesce(h.category, p.category) AS category,
      CASE WHEN h.parent_asin IS NULL THEN p.title ELSE h.title END AS title, CASE WHEN h.parent_asin IS NULL THEN p.brand ELSE h.brand END AS brand,
      coalesce(h.image_url, p.image_url) AS image_url, CASE WHEN h.parent_asin IS NULL THEN p.niche ELSE roll.niche END AS niche
    FROM product_parents p FULL JOIN heads h ON h.parent_asin = p.parent_asin LEFT JOIN roll ON roll.parent_asin = h.parent_asin)""", ["rp", "products", "product_parents"])
def _(t):
    return _ingested(t)[1]


_DETAILED = f"""d AS ({CTE_DETAIL}),
  hd AS (SELECT parent_asin, arg_max(main_niche, seq) FILTER (WHERE main_niche IS NOT NULL) AS niche, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
      arg_max(brand, seq) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(image_url, seq) FILTER (WHERE image_url IS NOT NULL) AS image_url FROM d GROUP BY 1),
  ap AS (SELECT coalesce(p.asin, d.asin) AS asin, CASE WHEN p.asin IS NULL THEN d.parent_asin ELSE p.parent_asin END AS parent_asin,
      coalesce(d.title, p.title) AS title, coalesce(d.brand, p.brand) AS brand, coalesce(d.image_url, p.image_url) AS image_url,
      coalesce(d.material0, p.material) AS material, coalesce(d.main_niche, p.main_niche) AS main_niche, coalesce(d.aud0, p.target_audience) AS target_audience
    FROM products p FULL JOIN (SELECT * FROM d WHERE asin IS NOT NULL) d ON d.asin = p.asin)"""
_DCOLS = ["asin", "parent_asin", "title", "brand", "image_url", "material", "main_niche", "target_audience"]


def _detailed(t):
    return linkage.enrich_details(raw_products(t), t.products, t.product_parents, "comforter", "seq")


@query("enrich_details", f"SELECT * FROM (WITH {_DETAILED} SELECT * FROM ap)", ["rp", "products"])
def _(t):
    return _detailed(t)[0].select(*_DCOLS)


@query("enrich_details_parents", f"""SELECT * FROM (WITH {_DETAILED}
    SELECT coalesce(p.parent_asin, h.parent_asin) AS parent_asin,
      CASE WHEN p.parent_asin IS NULL THEN 'comforter' WHEN h.parent_asin IS NOT NULL AND (p.category IS NULL OR p.category IN ('Unknown', 'comforter')) THEN 'comforter' ELSE p.category END AS category,
      coalesce(h.title, p.title) AS title, coalesce(h.brand, p.brand) AS brand, coalesce(h.image_url, p.image_url) AS image_url,
      CASE WHEN h.parent_asin IS NOT NULL AND coalesce(p.parent_asin, h.parent_asin) IN (SELECT parent_asin FROM ap GROUP BY 1 HAVING count(DISTINCT main_niche) > 1) THEN 'Multi-Niche'
        ELSE coalesce(h.niche, p.niche) END AS niche
    FROM product_parents p FULL JOIN hd h ON h.parent_asin = p.parent_asin)""", ["rp", "products", "product_parents"])
def _(t):
    return _detailed(t)[1]


_BF = """bf AS (SELECT asin, coalesce(title, '') AS title, CASE WHEN contains(coalesce(manufacturer, 'N/A'), 'N/A') THEN 'N/A' ELSE trim(split_part(replace(manufacturer, 'by ', ''), '(', 1)) END AS brand,
      imageUrlList[1] AS image_url, coalesce(TRY_CAST(split_part(coalesce(productRating, '0'), ' ', 1) AS DOUBLE), 0) AS avg_r, coalesce(countReview, 0) AS total
    FROM rp WHERE statusCode = 200 AND asin <> '')"""


@query("apply_backfill", f"""SELECT * FROM (WITH {_BF} SELECT p.asin, coalesce(bf.title, p.title) AS title, coalesce(bf.brand, p.brand) AS brand, coalesce(bf.image_url, p.image_url) AS image_url,
    CASE WHEN bf.asin IS NULL THEN p.real_average_rating ELSE avg_r END AS real_average_rating, CASE WHEN bf.asin IS NULL THEN p.real_total_ratings ELSE total END AS real_total_ratings, p.category
    FROM products p LEFT JOIN bf ON bf.asin = p.asin)""", ["rp", "products"])
def _(t):
    from reviewatlas.operators.clean import clean_backfill

    rows = clean_backfill(raw_products(t))
    return linkage.apply_backfill(rows, t.products, t.product_parents)[0].select(
        "asin", "title", "brand", "image_url", "real_average_rating", "real_total_ratings", "category"
    )


@query("apply_backfill_parents", f"""SELECT * FROM (WITH {_BF}, n AS (SELECT *, CASE WHEN lower(title) LIKE '%draw%' OR lower(title) LIKE '%book%' THEN 'book' ELSE 'comforter' END AS category,
      CASE WHEN lower(title) LIKE '%how to draw%' THEN 'How to Draw' END AS niche FROM bf)
    SELECT coalesce(p.parent_asin, n.asin) AS parent_asin, coalesce(n.category, p.category) AS category, coalesce(n.niche, p.niche) AS niche, coalesce(n.title, p.title) AS title,
      coalesce(n.brand, p.brand) AS brand, coalesce(n.image_url, p.image_url) AS image_url FROM product_parents p FULL JOIN n ON n.asin = p.parent_asin)""", ["rp", "product_parents"])
def _(t):
    from reviewatlas.operators.clean import clean_backfill

    return linkage.apply_backfill(clean_backfill(raw_products(t)), t.products, t.product_parents)[1].select(
        "parent_asin", "category", "niche", "title", "brand", "image_url"
    )


@query("enrich_children", """SELECT * FROM (WITH v AS (SELECT 'V' || substr(child_asin, 2) AS asin, parent_asin, min('T ' || variation_text) AS title FROM reviews
      WHERE parent_asin IN (SELECT parent_asin FROM product_parents) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY 'V' || substr(child_asin, 2) ORDER BY parent_asin) = 1)
    SELECT asin, parent_asin, title FROM products UNION ALL SELECT * FROM v)""", ["reviews", "products", "product_parents"])
def _(t):
    raw = t.reviews.select(
        F.concat(F.lit("V"), F.substring("child_asin", 2, 9)).alias("variationId"), F.col("parent_asin").alias("asin"),
        F.concat(F.lit("T "), "variation_text").alias("productTitle"), F.lit(None).cast("string").alias("image"), F.col("variation_text").alias("spec"),
    )
    return linkage.enrich_children(raw, t.products.select("asin", "parent_asin", "title"), t.product_parents)


@query("add_ghost_parents", """SELECT * FROM (WITH s AS (SELECT asin, parent_asin, title FROM products WHERE NOT (asin = parent_asin AND CAST(substr(asin, 2) AS BIGINT) % 3 = 0))
    SELECT *, CAST(NULL AS VARCHAR) AS status_asin FROM s
    UNION ALL SELECT parent_asin, parent_asin, arg_min(title, asin), 'AUTO_GENERATED_PARENT' FROM s WHERE parent_asin NOT IN (SELECT asin FROM s) GROUP BY 1)""", ["products"])
def _(t):
    own = (F.col("asin") == F.col("parent_asin")) & (F.substring("asin", 2, 9).cast("bigint") % 3 == 0)
    return linkage.add_ghost_parents(t.products.select("asin", "parent_asin", "title").filter(~own))


# --- truth repair ----------------------------------------------------------------------------


def labelled(t):
    """Catalogue whose categories and niches fit the repair rules."""
    key = F.substring("parent_asin", 2, 9).cast("bigint")
    parents = t.product_parents.select(
        "parent_asin", F.when(key % 3 == 0, "book").when(key % 3 == 1, "tumbler").otherwise("comforter").alias("category"),
        F.concat("title", F.when(key % 4 == 0, " Tumbler").when(key % 4 == 1, " how to draw").otherwise("")).alias("title"),
        F.concat(F.lit("Brand: "), "brand").alias("brand"), "image_url", F.when(key % 2 == 0, F.lit("unknown")).otherwise(F.col("niche")).alias("niche"),
    )
    k = F.substring("asin", 2, 9).cast("bigint")
    products = t.products.select(
        "asin", "parent_asin", F.concat("title", F.when(k % 5 == 0, " Kids steel").otherwise("")).alias("title"),
        F.concat("brand", F.lit(" Store")).alias("brand"), F.when(k % 2 == 0, F.col("material")).alias("material"), "target_audience", "main_niche",
    )
    return products, parents


_LAB = """lp AS (SELECT parent_asin, CASE k % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'tumbler' ELSE 'comforter' END AS category,
      title || CASE k % 4 WHEN 0 THEN ' Tumbler' WHEN 1 THEN ' how to draw' ELSE '' END AS title, 'Brand: ' || brand AS brand, image_url,
      CASE WHEN k % 2 = 0 THEN 'unknown' ELSE niche END AS niche FROM (SELECT *, CAST(substr(parent_asin, 2) AS BIGINT) AS k FROM product_parents)),
  fp AS (SELECT parent_asin, category, title, brand, image_url, CASE WHEN category = 'book' AND (niche = 'unknown' OR niche IS NULL) AND title ILIKE '%draw%' THEN 'Drawing Books' ELSE niche END AS niche
    FROM (SELECT * REPLACE (CASE WHEN title ILIKE '%tumbler%' THEN 'tumbler' ELSE category END AS category, replace(brand, 'Brand: ', '') AS brand) FROM lp)),
  lc AS (SELECT asin, parent_asin, title || CASE WHEN k % 5 = 0 THEN ' Kids steel' ELSE '' END AS title, brand AS brand, CASE WHEN k % 2 = 0 THEN material END AS material, target_audience, main_niche
    FROM (SELECT *, CAST(substr(asin, 2) AS BIGINT) AS k FROM products))"""


@query("repair_catalogue_parents", f"SELECT * FROM (WITH {_LAB} SELECT * FROM fp)", ["product_parents", "products"])
def _(t):
    return linkage.repair_catalogue(*labelled(t))[1]


@query("repair_catalogue_products", f"""SELECT * FROM (WITH {_LAB},
    s AS (SELECT lc.* REPLACE (CASE WHEN material IS NULL AND fp.category = 'tumbler' AND lc.title ILIKE '%steel%' THEN 'Stainless Steel' ELSE material END AS material),
      fp.category AS cat, fp.niche AS fniche, fp.parent_asin IS NOT NULL AS hit FROM lc LEFT JOIN fp ON fp.parent_asin = lc.parent_asin),
    u AS (SELECT *, (material IS NULL OR target_audience IS NULL) AND cat = 'book' AND title ILIKE '%kids%' AS kid FROM s)
    SELECT asin, parent_asin, title, brand, CASE WHEN kid THEN 'Paper' ELSE material END AS material, CASE WHEN kid THEN 'Kids' ELSE target_audience END AS target_audience,
      CASE WHEN hit THEN fniche ELSE main_niche END AS main_niche FROM u)""", ["product_parents", "products"])
def _(t):
    return linkage.repair_catalogue(*labelled(t))[0]


@query("sync_missing_parents", """SELECT * FROM (WITH m AS (SELECT parent_asin, 'unclassified' AS category, max(title) AS title, max(brand) AS brand, CAST(NULL AS VARCHAR) AS image_url,
      coalesce(max(main_niche), 'unknown') AS niche FROM products WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents) AND parent_asin IN (SELECT asin FROM products WHERE asin = parent_asin) GROUP BY 1),
    f AS (SELECT parent_asin, category, title, brand, image_url, niche FROM product_parents UNION ALL SELECT * FROM m)
    SELECT parent_asin, coalesce(category, 'unclassified') AS category, title, brand, image_url,
      CASE WHEN parent_asin IN (SELECT parent_asin FROM products GROUP BY 1 HAVING count(DISTINCT main_niche) > 1) THEN 'Multi-Niche' ELSE coalesce(niche, 'unknown') END AS niche FROM f)""",
       ["product_parents", "products"])
def _(t):
    return linkage.sync_missing_parents(t.products, t.product_parents)


def sheet(t, remainder: int):
    """A truth source over a third of the catalogue; children move to another family."""
    key = F.substring("asin", 2, 9).cast("bigint")
    to = F.concat(F.lit("A"), F.lpad((key - key % 10).cast("string"), 9, "0"))
    return t.products.filter(key % 3 == remainder).select(
        "asin", F.when(key % 8 != 0, to).alias("parent_asin"), "category", "brand", "title", "main_niche", F.col("main_niche").alias("niche")
    )


def _sheet(name: str, remainder: int) -> str:
    return f"""{name} AS (SELECT asin, CASE WHEN k % 8 <> 0 THEN 'A' || lpad(CAST(k - k % 10 AS VARCHAR), 9, '0') END AS parent_asin, category, brand, title, main_niche AS niche
      FROM (SELECT *, CAST(substr(asin, 2) AS BIGINT) AS k FROM products) WHERE k % 3 = {remainder})"""


_SOURCES = f"""{_sheet('s0', 0)}, {_sheet('s1', 1)},
    h AS (SELECT coalesce(parent_asin, asin) AS parent_asin, category, brand, title, niche, asin, 0 AS prio FROM s0 UNION ALL SELECT coalesce(parent_asin, asin), category, brand, title, niche, asin, 1 FROM s1)"""


@query("rebuild_parents", f"""SELECT * FROM (WITH {_SOURCES} SELECT parent_asin, category, brand, title, niche FROM h
    QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY prio, category, brand, title, niche) = 1)""", ["products"])
def _(t):
    cols = ["asin", "parent_asin", "category", "brand", "title", "niche"]
    return linkage.rebuild_parents(t.products, [sheet(t, 0).select(*cols), sheet(t, 1).select(*cols)])[1]


@query("rebuild_parents_links", f"SELECT * FROM (WITH {_SOURCES} SELECT p.asin, coalesce(h.parent_asin, p.parent_asin) AS parent_asin FROM products p LEFT JOIN h ON h.asin = p.asin)", ["products"])
def _(t):
    cols = ["asin", "parent_asin", "category", "brand", "title", "niche"]
    return linkage.rebuild_parents(t.products, [sheet(t, 0).select(*cols), sheet(t, 1).select(*cols)])[0].select("asin", "parent_asin")


_TRUTH = f"""{_sheet('s0', 0)}, r AS (SELECT * FROM s0 WHERE parent_asin IS NOT NULL),
    heads AS (SELECT parent_asin, 'PROMO' AS category, title, brand, niche FROM r QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY asin) = 1)"""


def _truth(t):
    return linkage.apply_truth(t.products, t.product_parents, t.reviews, sheet(t, 0), "PROMO")


@query("apply_truth_products", f"""SELECT * FROM (WITH {_TRUTH} SELECT p.asin, coalesce(r.parent_asin, h.parent_asin, p.parent_asin) AS parent_asin
    FROM products p LEFT JOIN r ON r.asin = p.asin LEFT JOIN heads h ON h.parent_asin = p.asin)""", ["products"])
def _(t):
    return _truth(t)[0].select("asin", "parent_asin")


@query("apply_truth_parents", f"""SELECT * FROM (WITH {_TRUTH}, f AS (SELECT parent_asin, category, title, brand, niche FROM product_parents
      UNION ALL SELECT * FROM heads WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents))
    SELECT * FROM f WHERE coalesce(category <> 'PROMO', true) OR parent_asin IN (SELECT parent_asin FROM heads))""", ["products", "product_parents"])
def _(t):
    return _truth(t)[1].select("parent_asin", "category", "title", "brand", "niche")


@query("apply_truth_reviews", f"SELECT * FROM (WITH {_TRUTH} SELECT review_id, coalesce(r.parent_asin, v.parent_asin) AS parent_asin FROM reviews v LEFT JOIN r ON r.asin = v.child_asin)", ["products", "reviews"])
def _(t):
    return _truth(t)[2].select("review_id", "parent_asin")


@query("cleanup_orphans_parents", f"""SELECT * FROM (WITH {_sheet('s0', 0)},
    h AS (SELECT parent_asin, category, brand, niche FROM s0 WHERE parent_asin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY asin) = 1),
    o AS (SELECT * REPLACE (CASE WHEN category = 'LARGE' THEN 'unclassified' ELSE category END AS category) FROM product_parents)
    SELECT coalesce(o.parent_asin, h.parent_asin) AS parent_asin,
      CASE WHEN h.parent_asin IS NULL OR o.category <> 'unclassified' THEN o.category ELSE h.category END AS category,
      CASE WHEN h.parent_asin IS NULL OR o.category <> 'unclassified' THEN o.brand ELSE h.brand END AS brand,
      CASE WHEN h.parent_asin IS NULL OR o.category <> 'unclassified' THEN o.niche ELSE h.niche END AS niche,
      coalesce(o.title, 'Imported from Excel') AS title FROM o FULL JOIN h ON h.parent_asin = o.parent_asin)""", ["products", "product_parents"])
def _(t):
    vague = t.product_parents.withColumn("category", F.when(F.col("category") == "LARGE", "unclassified").otherwise(F.col("category")))
    return linkage.cleanup_orphans(t.products, vague, sheet(t, 0))[1].select("parent_asin", "category", "brand", "niche", "title")


@query("cleanup_orphans_products", f"""SELECT * FROM (WITH {_sheet('s0', 0)}, o AS (SELECT asin, min(parent_asin) AS parent_asin FROM s0 GROUP BY 1)
    SELECT p.asin, coalesce(o.parent_asin, p.parent_asin) AS parent_asin FROM products p LEFT JOIN o ON o.asin = p.asin)""", ["products"])
def _(t):
    return linkage.cleanup_orphans(t.products, t.product_parents, sheet(t, 0))[0].select("asin", "parent_asin")


@query("parent_centric", """SELECT parent_asin AS asin, parent_asin, title, brand FROM products
    QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY (asin = parent_asin) DESC, asin) = 1""", ["products"])
def _(t):
    return linkage.parent_centric(t.products).select("asin", "parent_asin", "title", "brand")


@query("target_ids", f"SELECT * FROM (WITH {_sheet('s0', 0)} SELECT asin FROM s0 UNION SELECT parent_asin FROM s0 WHERE parent_asin IS NOT NULL)", ["products"])
def _(t):
    return linkage.target_ids(sheet(t, 0))
