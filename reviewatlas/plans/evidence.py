"""Registered queries: profiles, evidence and the explorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import evidence, stats
from reviewatlas.plans.comparing import impact
from reviewatlas.plans.registry import query

_EV = """SELECT q.parent_asin, tag_id, q.aspect, q.sentiment, quote, variation_text, review_date
    FROM quoted_norm q JOIN reviews_text r USING (review_id) WHERE {where}
    QUALIFY row_number() OVER (PARTITION BY q.parent_asin ORDER BY review_date DESC, tag_id) <= 30"""


@query("search_evidence", _EV.format(where="true"), ["quoted_norm", "reviews_text"])
def _(t):
    return evidence.search_evidence(t.review_tags_quoted, t.reviews, t.aspect_mapping)


@query("search_evidence_filtered", _EV.format(
    where="(lower(std) = 'std-g' OR lower(raw) = 'std-g') AND q.sentiment = 'Negative' AND "
          "(contains(lower(quote), 'the') OR contains(lower(text), 'the') OR contains(lower(quote), 'laou') OR contains(lower(text), 'laou'))"),
    ["quoted_norm", "reviews_text"])
def _(t):
    return evidence.search_evidence(t.review_tags_quoted, t.reviews_text, t.aspect_mapping, aspect="STD-G ", sentiment="Negative", keywords="the, laou")


@query("search_evidence_product", _EV.format(where="q.parent_asin = 'A000000010' AND lower(raw) = 'red'"), ["quoted_norm", "reviews_text"])
def _(t):
    return evidence.search_evidence(t.review_tags_quoted, t.reviews, t.aspect_mapping, asin="A000000010", aspect="red")


@query("evidence_board", """
    SELECT parent_asin, tag_id, coalesce(std_category, category) AS category,
      CASE WHEN std IS NOT NULL THEN '✅ ' || std ELSE '⏳ ' || raw END AS aspect_status, sentiment, quote
    FROM quoted_norm QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY sentiment DESC, coalesce(std_category, category), tag_id) <= 300""", ["quoted_norm"])
def _(t):
    return evidence.evidence_board(t.review_tags_quoted, t.aspect_mapping)


def _group_sql(groups: dict[str, list[str]], kind: str) -> str:
    return " UNION ALL ".join(
        f"SELECT parent_asin, '{g}' AS grp, count(*) AS cnt, '{kind}' AS kind FROM reviews_text WHERE "
        + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + " GROUP BY 1"
        for g, words in groups.items()
    )


@query("customer_context", _group_sql(evidence.AUDIENCE, "target_audience") + " UNION ALL " + _group_sql(evidence.OCCASIONS, "usage_occasion"), ["reviews_text"])
def _(t):
    return evidence.customer_context(t.reviews_text)


_TOP = """(SELECT parent_asin, string_agg(aspect, ', ' ORDER BY cnt DESC, aspect) AS names FROM (
      SELECT parent_asin, aspect, count(*) AS cnt FROM tags_norm WHERE sentiment = '{}' GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY count(*) DESC, aspect) <= 5) GROUP BY 1)"""


@query("listing_brief", f"""SELECT asin, title, material, main_niche, target_audience, coalesce(n.names, 'None') AS pain_points, coalesce(s.names, 'None') AS strengths
    FROM products p LEFT JOIN {_TOP.format('Negative')} n ON n.parent_asin = p.asin LEFT JOIN {_TOP.format('Positive')} s ON s.parent_asin = p.asin
    WHERE asin = p.parent_asin""", ["products", "tags_norm"])
def _(t):
    return evidence.listing_brief(t.products, t.review_tags, t.aspect_mapping)


@query("product_dna", """
    SELECT pp.parent_asin, pp.category, pp.niche, pp.title, pp.brand, pp.image_url, p.material, p.target_audience, p.size_capacity, p.product_line, p.variation_count,
      round(coalesce(k.avg_rating, p.real_average_rating), 6) AS avg_rating, coalesce(k.total_reviews, p.real_total_ratings) AS total_reviews, s.strengths, w.weaknesses
    FROM product_parents pp LEFT JOIN products p ON p.asin = pp.parent_asin LEFT JOIN kpis k ON k.asin = pp.parent_asin
    LEFT JOIN (SELECT parent_asin, string_agg(aspect, '|' ORDER BY total_impact_vol DESC, net_impact DESC, aspect) AS strengths FROM (SELECT * FROM impact WHERE net_impact > 0
        QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY total_impact_vol DESC, net_impact DESC, aspect) <= 5) GROUP BY 1) s ON s.parent_asin = pp.parent_asin
    LEFT JOIN (SELECT parent_asin, string_agg(aspect, '|' ORDER BY total_impact_vol DESC, net_impact DESC, aspect) AS weaknesses FROM (SELECT * FROM impact WHERE net_impact < 0
        QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY total_impact_vol, net_impact, aspect DESC) <= 5) GROUP BY 1) w ON w.parent_asin = pp.parent_asin""",
       ["product_parents", "products", "kpis", "impact"])
def _(t):
    dna = evidence.product_dna(t.products, t.product_parents, stats.product_kpis(t.products, t.reviews), impact(t))
    return dna.withColumn("avg_rating", F.round("avg_rating", 6))


_CATALOGUE = """SELECT pp.parent_asin, pp.category, pp.niche, pp.brand, pp.title, avg_rating, coalesce(variations, 0) AS variations FROM product_parents pp
    LEFT JOIN (SELECT parent_asin AS key, max(real_average_rating) AS avg_rating, count(*) AS variations FROM products GROUP BY 1) ON key = pp.parent_asin"""


@query("catalogue", _CATALOGUE, ["product_parents", "products"])
def _(t):
    return evidence.ordered_catalogue(evidence.catalogue(t.product_parents, t.products))


# most variations move to parents that the catalogue lacks, and so every second family has none
_MOVED = "CASE WHEN asin LIKE '%0' OR asin LIKE '%1' THEN parent_asin ELSE 'X' || parent_asin END"


@query("variation_pool", f"SELECT pp.parent_asin, p.asin FROM product_parents pp LEFT JOIN (SELECT asin, {_MOVED} AS family FROM products) p ON p.family = pp.parent_asin", ["product_parents", "products"])
def _(t):
    return evidence.variation_pool(t.product_parents, t.products.withColumn("parent_asin", F.expr(_MOVED)))


@query("variation_text", "SELECT parent_asin, substr(asin, 1, 8) AS prefix, string_agg(asin, ',' ORDER BY asin) AS variation_pool FROM products GROUP BY 1, 2", ["products"])
def _(t):
    return evidence.variation_text(t.products)


# one family of all products: far more ids than any page
@query("variation_text_of_one_family", "SELECT 'A' AS parent_asin, substr(asin, 1, 9) AS prefix, string_agg(asin, ',' ORDER BY asin) AS variation_pool FROM products GROUP BY 2", ["products"])
def _(t):
    return evidence.variation_text(t.products.withColumn("parent_asin", F.lit("A")), 9)


@query("catalogue_variations", f"SELECT c.*, p.asin FROM ({_CATALOGUE}) c LEFT JOIN products p ON p.parent_asin = c.parent_asin", ["product_parents", "products"])
def _(t):
    return evidence.catalogue_variations(t.product_parents, t.products)


@query("filter_catalogue", f"SELECT * FROM ({_CATALOGUE} WHERE category = 'PROMO' AND contains(niche, 'gear'))", ["product_parents", "products"])
def _(t):
    return evidence.filter_catalogue(evidence.catalogue(t.product_parents, t.products), t.products, "PROMO", "gear")


@query("search_catalogue", f"""SELECT * FROM ({_CATALOGUE} WHERE contains(lower(pp.parent_asin), '11') OR contains(lower(title), '11') OR contains(lower(brand), '11')
    OR pp.parent_asin IN (SELECT parent_asin FROM products WHERE contains(lower(asin), '11')))""", ["product_parents", "products"])
def _(t):
    return evidence.filter_catalogue(evidence.catalogue(t.product_parents, t.products), t.products, term="11")


@query("niche_values", "SELECT DISTINCT trim(v) AS niche FROM (SELECT unnest(string_split(niche, ',')) AS v FROM product_parents) WHERE trim(v) NOT IN ('', 'Non-defined', 'unknown', 'null')", ["product_parents"])
def _(t):
    return evidence.niche_values(t.product_parents)


_FAMILY = ["size_capacity", "target_audience", "product_line", "variation_count", "real_average_rating", "real_total_ratings", "rating_breakdown"]


@query("family_detail", f"""SELECT * FROM (WITH c AS (SELECT * REPLACE (CASE WHEN category = 'SMALL' THEN 'X' || parent_asin ELSE parent_asin END AS parent_asin) FROM products)
    SELECT asin, parent_asin, title, brand, image_url, category, main_niche, material, {', '.join(_FAMILY)} FROM c
    UNION ALL SELECT parent_asin, parent_asin, title, brand, image_url, category, niche, NULL, {', '.join(['NULL'] * len(_FAMILY))} FROM product_parents
    WHERE parent_asin NOT IN (SELECT parent_asin FROM c))""", ["products", "product_parents"])
def _(t):
    return evidence.family_detail(t.products.withColumn("parent_asin", F.expr("IF(category = 'SMALL', 'X', '') || parent_asin")), t.product_parents)


@query("first_valid", "SELECT parent_asin, " + ", ".join(f"arg_min({c}, asin) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("brand", "image_url", "target_audience", "size_capacity"))
       + " FROM products GROUP BY 1", ["products"])
def _(t):
    return evidence.first_valid(t.products, ["brand", "image_url", "target_audience", "size_capacity"])


@query("products_with_reviews", "SELECT asin AS parent_asin, brand, title, real_average_rating AS avg_rating FROM products WHERE asin IN (SELECT parent_asin FROM reviews)", ["products", "reviews"])
def _(t):
    return evidence.products_with_reviews(t.products, t.reviews)


_LATEST = ["review_id", "parent_asin", "review_date", "rating_score", "variation_text", "is_verified"]


def _latest_sql(where: str) -> str:
    return f"""SELECT {', '.join(_LATEST)} FROM reviews WHERE {where}
    QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY review_date DESC, review_id) <= 50"""


@query("latest_reviews", _latest_sql("true"), ["reviews"])
def _(t):
    return evidence.latest_reviews(t.reviews.select(*_LATEST))


@query("latest_low_reviews", _latest_sql("rating_score <= 3"), ["reviews"])
def _(t):
    return evidence.latest_reviews(t.reviews.select(*_LATEST), 3)


@query("user_requests", """SELECT requested_by, request_id, asin, status, created_at FROM queue
    QUALIFY row_number() OVER (PARTITION BY requested_by ORDER BY created_at DESC, request_id) <= 5""", ["queue"])
def _(t):
    return evidence.user_requests(t.scrape_queue)


_TRIAGE = """SELECT * FROM (WITH req AS (SELECT request_id, CASE WHEN CAST(request_id AS BIGINT) % 9 = 0 THEN 'Z' || substr(asin, 2) ELSE asin END AS asin, coalesce(note, '') AS note, CAST(request_id AS BIGINT) % 4 = 0 AS force FROM queue),
    l AS (SELECT asin, parent_asin FROM products UNION ALL SELECT DISTINCT parent_asin, parent_asin FROM products WHERE parent_asin NOT IN (SELECT asin FROM products)),
    m AS (SELECT req.*, l.parent_asin, coalesce(l.parent_asin, req.asin) AS final_asin FROM req LEFT JOIN l ON l.asin = req.asin),
    rv AS (SELECT parent_asin AS key, count(*) AS n, max(review_date) AS last_date FROM (SELECT * REPLACE (CASE WHEN rating_score = 5 AND helpful_count = 7 THEN parent_asin ELSE 'Y' || parent_asin END AS parent_asin) FROM reviews) GROUP BY 1),
    w AS (SELECT DISTINCT CASE WHEN requested_by % 2 = 0 THEN '' ELSE 'Y' END || asin AS key FROM queue WHERE status IN ('PENDING_APPROVAL', 'READY_TO_SCRAPE', 'IN_PROGRESS'))
    SELECT request_id, asin, final_asin,
      CASE WHEN n > 0 AND NOT force THEN 'HAS_DATA' WHEN w.key IS NOT NULL THEN 'ALREADY_QUEUED' WHEN parent_asin IS NULL THEN 'QUEUED_UNKNOWN' WHEN final_asin <> asin THEN 'QUEUED_AS_PARENT' ELSE 'QUEUED' END AS decision,
      CASE WHEN parent_asin IS NULL THEN '[Unknown ASIN] Not in Product DB. Admin verify Parent.' WHEN final_asin <> asin THEN '[Auto-Map] Child ' || asin || ' -> Parent ' || final_asin ELSE '' END
      || CASE WHEN n > 0 AND force THEN ' | [Force Update Requested] Previous Data: ' || n || ' reviews, Last: ' || last_date ELSE '' END
      || CASE WHEN note <> '' THEN ' | ' || note ELSE '' END AS full_note
    FROM m LEFT JOIN rv ON rv.key = final_asin LEFT JOIN w ON w.key = final_asin)"""


@query("triage_requests", _TRIAGE, ["queue", "products", "reviews"])
def _(t):
    return triaged(t)[0]


def triaged(t):
    """(decisions, requests) for the queue's own requests, some under unknown ids."""
    number = F.col("request_id").cast("bigint")
    odd = F.when(number % 9 == 0, F.concat(F.lit("Z"), F.substring("asin", 2, 9))).otherwise(F.col("asin"))
    requests = t.scrape_queue.select("request_id", odd.alias("asin"), F.coalesce("note", F.lit("")).alias("note"), (number % 4 == 0).alias("force"))
    # most reviews and waiting requests belong to other products
    scarce = t.reviews.withColumn("parent_asin", F.expr("IF(rating_score = 5 AND helpful_count = 7, '', 'Y') || parent_asin"))
    waiting = t.scrape_queue.withColumn("asin", F.expr("IF(requested_by % 2 = 0, '', 'Y') || asin"))
    return evidence.triage_requests(requests, t.products, scarce, waiting), t.scrape_queue


@query("accepted_requests", f"""SELECT d.request_id, final_asin AS asin, 'PENDING_APPROVAL' AS status, requested_by, full_note AS note, DATE '2024-01-31' AS created_at
    FROM ({_TRIAGE}) d JOIN queue USING (request_id) WHERE decision LIKE 'QUEUED%' QUALIFY row_number() OVER (PARTITION BY final_asin ORDER BY d.request_id) = 1""", ["queue", "products", "reviews"])
def _(t):
    return evidence.accepted_requests(*triaged(t), F.to_date(F.lit("2024-01-31")))


@query("decided_requests", "SELECT request_id, asin, CASE WHEN status = 'PENDING_APPROVAL' AND requested_by % 2 = 0 THEN 'READY_TO_SCRAPE' WHEN status = 'PENDING_APPROVAL' THEN 'REJECTED' ELSE status END AS status FROM queue", ["queue"])
def _(t):
    waiting = t.scrape_queue.filter("status = 'PENDING_APPROVAL'")
    approved = evidence.decide_requests(t.scrape_queue, waiting.filter("requested_by % 2 = 0"), True)
    return evidence.decide_requests(approved, waiting.filter("requested_by % 2 <> 0"), False).select("request_id", "asin", "status")


@query("dispatched_requests", "SELECT request_id, asin, CASE WHEN status = 'COMPLETED' THEN CASE WHEN asin IN (SELECT asin FROM products WHERE category = 'PROMO') THEN 'IN_PROGRESS' ELSE 'READY_TO_SCRAPE' END ELSE status END AS status FROM queue", ["queue", "products"])
def _(t):
    ready = evidence.decide_requests(t.scrape_queue, t.scrape_queue.filter("status = 'COMPLETED'"), True)
    return evidence.dispatch_requests(ready, t.products.filter("category = 'PROMO'")).select("request_id", "asin", "status")


@query("chat_pairs", """SELECT u.conv_id || '_' || u.turn AS chat_id, md5(u.text) AS user_query, md5(a.text) AS ai_response FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def _(t):
    pairs = evidence.chat_pairs(t.raw("conversations"))
    return pairs.select("chat_id", F.md5("user_query").alias("user_query"), F.md5("ai_response").alias("ai_response"))
