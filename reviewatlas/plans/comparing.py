"""Registered queries: product against product."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import compare, stats
from reviewatlas.plans.registry import query


def impact(t):
    return stats.estimated_impact(t.products, t.reviews, t.review_tags, t.aspect_mapping)


BENCH = """bench AS (SELECT main_niche, aspect, sum(est_positive) / sum(est_positive + est_negative)::DOUBLE * 100 AS market_avg
    FROM impact i JOIN products p ON p.asin = i.parent_asin GROUP BY 1, 2 HAVING sum(est_positive + est_negative) > 50)"""


@query("niche_benchmark", f"SELECT * FROM (WITH {BENCH} SELECT main_niche, aspect, round(market_avg, 6) AS market_avg FROM bench)", ["impact", "products"])
def _(t):
    return compare.niche_benchmark(impact(t), t.products).withColumn("market_avg", F.round("market_avg", 6))


@query("battle", f"""SELECT * FROM (WITH {BENCH}
    SELECT a, b, x.aspect, x.est_positive AS pop_a, y.est_positive AS pop_b,
      round(x.est_positive / (x.est_positive + x.est_negative + 1e-9::DOUBLE) * 100, 6) AS sat_a,
      round(y.est_positive / (y.est_positive + y.est_negative + 1e-9::DOUBLE) * 100, 6) AS sat_b, round(market_avg, 6) AS market_avg,
      CASE WHEN greatest(x.est_positive, y.est_positive) < 2
             OR abs(x.est_positive - y.est_positive)::DOUBLE / greatest(x.est_positive, y.est_positive) < 0.1 THEN 'tie'
           WHEN x.est_positive > y.est_positive THEN 'a' ELSE 'b' END AS winner
    FROM pairs JOIN impact x ON x.parent_asin = a JOIN impact y ON y.parent_asin = b AND x.aspect = y.aspect
    LEFT JOIN products p ON p.asin = a LEFT JOIN bench ON bench.main_niche = p.main_niche AND bench.aspect = x.aspect
    WHERE x.est_positive > 0 AND y.est_positive > 0)""", ["impact", "products", "pairs"])
def _(t):
    out = compare.battle(impact(t), t.products, t.pairs)
    for c in ("sat_a", "sat_b", "market_avg"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("unique_aspects", """
    SELECT a, b, 'a' AS side, aspect, est_positive FROM pairs JOIN impact x ON x.parent_asin = a
    WHERE est_positive > 0 AND NOT EXISTS (SELECT 1 FROM impact y WHERE y.parent_asin = b AND y.aspect = x.aspect)
    UNION ALL SELECT a, b, 'b', aspect, est_positive FROM pairs JOIN impact x ON x.parent_asin = b
    WHERE est_positive > 0 AND NOT EXISTS (SELECT 1 FROM impact y WHERE y.parent_asin = a AND y.aspect = x.aspect)""", ["impact", "pairs"])
def _(t):
    return compare.unique_aspects(impact(t), t.pairs)


@query("top_weaknesses", """SELECT * FROM (SELECT parent_asin, aspect, est_negative,
    CAST(row_number() OVER (PARTITION BY parent_asin ORDER BY est_negative DESC, aspect) AS INTEGER) AS rank
    FROM impact WHERE net_impact < 0) WHERE rank <= 5""", ["impact"])
def _(t):
    return compare.top_weaknesses(impact(t))


_SIDES = """SELECT parent_asin, aspect, count(*) AS mentions,
    round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0::DOUBLE / count(*), 1) AS pos_ratio
    FROM tags_norm GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("head_to_head", f"""SELECT * FROM (WITH s AS ({_SIDES})
    SELECT a, b, x.aspect, x.pos_ratio AS score_a, y.pos_ratio AS score_b, x.mentions AS mentions_a, y.mentions AS mentions_b
    FROM pairs JOIN s x ON x.parent_asin = a JOIN s y ON y.parent_asin = b AND y.aspect = x.aspect
    QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY x.mentions + y.mentions DESC, x.aspect) <= 10)""", ["tags_norm", "pairs"])
def _(t):
    return compare.head_to_head(t.review_tags, t.aspect_mapping, t.pairs)


_LEGACY = """SELECT parent_asin, aspect, count(*) AS mentions, count(*) FILTER (WHERE sentiment = 'Positive') * 100.0::DOUBLE / count(*) AS pos_pct
    FROM tags_exact GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("legacy_battle", f"""SELECT * FROM (WITH s AS ({_LEGACY}),
    p AS (SELECT a, b, 'a' AS side, a AS me, b AS them FROM pairs UNION ALL SELECT a, b, 'b', b, a FROM pairs)
    SELECT a, b, side, x.aspect, x.mentions, round(x.pos_pct, 6) AS pos_pct, y.aspect IS NOT NULL AS shared, x.pos_pct > 70 AS strong
    FROM p JOIN s x ON x.parent_asin = me LEFT JOIN s y ON y.parent_asin = them AND y.aspect = x.aspect)""", ["tags_exact", "pairs"])
def _(t):
    return compare.legacy_battle(t.review_tags, t.aspect_mapping, t.pairs)


@query("tale_of_tape", """SELECT a, b, x.real_average_rating AS rating_a, x.real_total_ratings AS total_a,
    y.real_average_rating AS rating_b, y.real_total_ratings AS total_b,
    round(y.real_average_rating - coalesce(x.real_average_rating, 0), 6) AS rating_delta,
    y.real_total_ratings - coalesce(x.real_total_ratings, 0) AS total_delta
    FROM pairs LEFT JOIN products x ON x.asin = a LEFT JOIN products y ON y.asin = b""", ["pairs", "products"])
def _(t):
    return compare.tale_of_tape(t.products, t.pairs)


_MATCH = """
    WITH h AS (SELECT p.asin, p.title, p.real_total_ratings, p.real_average_rating, p.product_line, pp.category, pp.niche
               FROM products p JOIN product_parents pp ON pp.parent_asin = p.asin WHERE p.asin = p.parent_asin),
    q AS (SELECT asin, category, coalesce(trim(split_part(niche, ',', 1)), 'NONE') AS wanted, coalesce(product_line, 'NONE') AS line,
            coalesce(real_total_ratings, 0) AS x FROM h),
    c AS (SELECT q.asin AS for_asin, h.*, CASE WHEN h.niche ILIKE '%' || wanted || '%' THEN 10 ELSE 0 END
            + CASE WHEN h.product_line = line THEN 1 ELSE 0 END AS score, abs(h.real_total_ratings - x) AS volume_gap,
            coalesce(contains(h.niche, wanted), false) OR coalesce(h.product_line = line, false) AS is_smart,
            h.real_total_ratings BETWEEN x * 0.6::DOUBLE AND x * 1.4::DOUBLE AS narrow,
            count(*) FILTER (WHERE h.real_total_ratings BETWEEN x * 0.6::DOUBLE AND x * 1.4::DOUBLE) OVER (PARTITION BY q.asin) AS hits
          FROM q JOIN h ON h.category = q.category AND h.asin <> q.asin
            AND h.real_total_ratings BETWEEN x * 0.4::DOUBLE AND x * 1.6::DOUBLE)
    SELECT * FROM (SELECT for_asin, asin, title, real_total_ratings, real_average_rating, product_line, category, niche, CAST(score AS INTEGER) AS score,
        volume_gap, is_smart, CAST(row_number() OVER (PARTITION BY for_asin ORDER BY score DESC, volume_gap, asin) AS INTEGER) AS rank
      FROM c WHERE narrow OR hits < 5) WHERE rank <= {k}"""


@query("match_competitors", f"SELECT * FROM ({_MATCH.format(k=100)})", ["products", "product_parents"])
def _(t):
    return compare.match_competitors(t.products, t.product_parents)


@query("match_competitors_top7", f"SELECT * FROM ({_MATCH.format(k=7)})", ["products", "product_parents"])
def _(t):
    return compare.match_competitors(t.products, t.product_parents, k=7)


# some families have no niche, some an empty one
_VAGUE = "(SELECT * REPLACE (CASE WHEN parent_asin LIKE '%05' THEN NULL WHEN parent_asin LIKE '%10' THEN '' ELSE niche END AS niche) FROM product_parents)"


def vague(t):
    return t.product_parents.withColumn("niche", F.expr("CASE WHEN parent_asin LIKE '%05' THEN NULL WHEN parent_asin LIKE '%10' THEN '' ELSE niche END"))


def _alternatives(where: str) -> str:
    return f"""
    SELECT * FROM (
      SELECT q.parent_asin AS for_asin, c.parent_asin, c.title, q.category, c.total_mentions, c.positive_score,
        CASE WHEN c.niche ILIKE '%' || coalesce(trim(split_part(q.niche, ',', 1)), '') || '%' THEN 1 ELSE 0 END AS niche_match,
        CAST(row_number() OVER (PARTITION BY q.parent_asin ORDER BY CASE WHEN c.niche ILIKE '%' || coalesce(trim(split_part(q.niche, ',', 1)), '') || '%' THEN 1 ELSE 0 END DESC,
          c.positive_score DESC, c.parent_asin, c.title) AS INTEGER) AS rank
      FROM {_VAGUE} q JOIN (
        SELECT p.parent_asin, p.title, pp.category, pp.niche, count(*) AS total_mentions,
          round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0::DOUBLE / count(*), 1) AS positive_score
        FROM products p JOIN {_VAGUE} pp ON pp.parent_asin = p.parent_asin JOIN tags_exact t ON t.parent_asin = p.parent_asin
        WHERE {where} GROUP BY 1, 2, 3, 4 HAVING count(*) > 10) c ON c.category = q.category AND c.parent_asin <> q.parent_asin)
    WHERE rank <= 3"""


@query("better_alternatives", _alternatives("std_category = 'Quality' OR std = 'Quality'"), ["products", "product_parents", "tags_exact"])
def _(t):
    return compare.better_alternatives(t.products, vague(t), t.review_tags, t.aspect_mapping, "Quality")


@query("better_alternatives_overall", _alternatives("true"), ["products", "product_parents", "tags_exact"])
def _(t):
    return compare.better_alternatives(t.products, vague(t), t.review_tags, t.aspect_mapping, None)


@query("competitor_gaps", f"""
    SELECT * FROM (WITH c AS (
      SELECT pp.parent_asin, pp.category, pp.niche, coalesce(pp.title, min(p.title)) AS title, coalesce(pp.brand, min(p.brand)) AS brand,
        max(real_average_rating) AS rating, max(real_total_ratings) AS reviews
      FROM products p JOIN {_VAGUE} pp ON pp.parent_asin = p.parent_asin
      GROUP BY pp.parent_asin, pp.category, pp.niche, pp.title, pp.brand HAVING max(real_total_ratings) > 5),
    r AS (SELECT q.parent_asin AS for_asin, c.parent_asin, substr(c.title, 1, 50) AS title, c.brand, round(c.rating, 2) AS rating, c.reviews,
        CAST(row_number() OVER (PARTITION BY q.parent_asin ORDER BY CASE WHEN c.niche ILIKE '%' || coalesce(trim(split_part(q.niche, ',', 1)), '') || '%' THEN 1 ELSE 0 END DESC,
          c.rating DESC NULLS LAST, c.reviews DESC, c.parent_asin) AS INTEGER) AS rank
      FROM {_VAGUE} q JOIN c ON c.category = q.category AND c.parent_asin <> q.parent_asin),
    w AS (SELECT parent_asin AS for_asin, aspect FROM tags_exact WHERE sentiment = 'Negative' GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY count(*) DESC, aspect) <= 3),
    g AS (SELECT r.for_asin, r.parent_asin, w.aspect, count(*) AS positive_mentions
      FROM r JOIN w ON w.for_asin = r.for_asin JOIN tags_exact t ON t.parent_asin = r.parent_asin AND (t.std = w.aspect OR t.raw = w.aspect)
      WHERE r.rank <= 3 AND t.sentiment = 'Positive' GROUP BY 1, 2, 3)
    SELECT r.*, g.aspect, g.positive_mentions FROM r LEFT JOIN g ON g.for_asin = r.for_asin AND g.parent_asin = r.parent_asin WHERE rank <= 3)""",
    ["products", "product_parents", "tags_exact"])
def _(t):
    return compare.competitor_gaps(t.products, vague(t), t.review_tags, t.aspect_mapping)


CELLS = """cells AS (SELECT asin, substr(CASE WHEN brand IN ('', 'None') THEN 'Unknown' ELSE brand END, 1, 10) || ' (' || asin || ')' AS label, aspect,
      est_positive - est_negative * 3.0::DOUBLE AS score, est_positive, est_negative, total_ratings
    FROM (SELECT p.asin, coalesce(pp.brand, p.brand, 'Unknown') AS brand, coalesce(p.real_total_ratings, 0) AS total_ratings
          FROM products p LEFT JOIN product_parents pp ON pp.parent_asin = p.asin) n JOIN impact ON impact.parent_asin = n.asin)"""


@query("heatmap_cells", f"SELECT * FROM (WITH {CELLS} SELECT * FROM cells)", ["impact", "products", "product_parents"])
def _(t):
    return compare.heatmap_cells(impact(t), t.products, t.product_parents)


@query("heatmap_drivers", f"""SELECT * FROM (WITH {CELLS},
    l AS (SELECT pp.parent_asin, pp.category, max(real_total_ratings) AS volume FROM products p JOIN product_parents pp ON pp.parent_asin = p.parent_asin GROUP BY 1, 2),
    cand AS (SELECT x.parent_asin AS for_asin, y.parent_asin AS asin FROM l x JOIN l y ON x.category = y.category AND x.parent_asin <> y.parent_asin
      QUALIFY row_number() OVER (PARTITION BY x.parent_asin ORDER BY y.volume DESC NULLS LAST, y.parent_asin) <= 15
      UNION ALL SELECT parent_asin, parent_asin FROM l),
    s AS (SELECT for_asin, aspect, sum(score) AS market_score, sum(abs(score)) AS weight FROM cand JOIN cells USING (asin) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, 'positive' AS section, CAST(row_number() OVER (PARTITION BY for_asin ORDER BY market_score DESC, aspect) AS INTEGER) AS rank FROM s WHERE market_score > 0
      UNION ALL SELECT *, 'negative', CAST(row_number() OVER (PARTITION BY for_asin ORDER BY market_score, aspect) AS INTEGER) FROM s WHERE market_score < 0) WHERE rank <= 10)""",
    ["impact", "products", "product_parents"])
def _(t):
    cells = compare.heatmap_cells(impact(t), t.products, t.product_parents)
    return compare.heatmap_drivers(cells, t.products, t.product_parents)


CHOSEN = ["A000000005", "A000000010", "A000000015", "A000000020", "A000000030"]


@query("heatmap_pivot", f"SELECT * FROM (WITH {CELLS} SELECT aspect, "
       + ", ".join(f"coalesce(max(score) FILTER (WHERE asin = '{c}'), 0) AS \"{c}\"" for c in CHOSEN)
       + f", sum(abs(score)) AS weight FROM cells WHERE asin IN ({', '.join(repr(c) for c in CHOSEN)}) GROUP BY 1 HAVING sum(abs(score)) > 0)",
       ["impact", "products", "product_parents"])
def _(t):
    return compare.heatmap_pivot(compare.heatmap_cells(impact(t), t.products, t.product_parents), CHOSEN)


@query("swot", """
    SELECT * FROM (WITH s AS (SELECT parent_asin, aspect, count(*) AS mentions,
        round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0::DOUBLE / count(*), 1) AS pos_ratio FROM quoted_norm GROUP BY 1, 2 HAVING count(*) >= 3),
    b AS (SELECT *, CASE WHEN pos_ratio >= 75 THEN 'strength' WHEN pos_ratio <= 40 THEN 'weakness' ELSE 'controversial' END AS bucket FROM s),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY parent_asin, bucket ORDER BY mentions DESC, aspect) AS INTEGER) AS rank FROM b)
    SELECT k.*, (SELECT min(quote) FROM quoted_norm q WHERE q.parent_asin = k.parent_asin AND k.bucket = 'weakness' AND q.sentiment = 'Negative'
        AND contains(lower(q.raw), lower(k.aspect))) AS sample_complaint
    FROM k WHERE rank <= 3 OR (rank <= 5 AND bucket <> 'controversial'))""", ["quoted_norm"])
def _(t):
    return compare.swot(t.review_tags_quoted, t.aspect_mapping)


@query("swot_summary", "SELECT asin AS parent_asin, round(avg_rating, 2) AS avg_rating, total_reviews FROM kpis", ["kpis"])
def _(t):
    return compare.swot_summary(stats.product_kpis(t.products, t.reviews))


@query("impact_scores", "SELECT parent_asin, aspect, round(est_positive / (est_positive + est_negative + 1e-9::DOUBLE) * 100, 6) AS sat FROM impact", ["impact"])
def _(t):
    sat = compare._percent(F.col("est_positive"), F.col("est_negative"))
    return impact(t).select("parent_asin", "aspect", F.round(sat, 6).alias("sat"))
