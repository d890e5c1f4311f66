"""Registered queries: all levels of the catalogue, sketches beside exact counts, feeds of changing shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import levels, sketches, social
from reviewatlas.plans.registry import QUERIES, query
from reviewatlas.plans.social import _POST
from reviewatlas.sources import variants

_SUMS = """count(*) AS products, count(real_total_ratings) AS has_meta, count(rating_breakdown) AS has_breakdown, coalesce(CAST(sum(n) AS BIGINT), 0) AS reviews,
      count(n) AS with_reviews, round(sum(score) / sum(n), 6) AS avg_rating, CAST(sum(real_total_ratings) AS BIGINT) AS total_ratings"""


def _level(name: str, keys: list[str]) -> str:
    shown = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in ("category", "niche", "parent_asin"))
    return f"SELECT '{name}' AS level, {shown}, {_SUMS} FROM r" + (f" GROUP BY {', '.join(keys)}" if keys else "")


# four separate queries
@query("catalogue_levels", """SELECT * FROM (WITH r AS (SELECT p.category, p.main_niche AS niche, p.parent_asin, real_total_ratings, rating_breakdown, n, score
      FROM products p LEFT JOIN (SELECT parent_asin AS key, count(*) AS n, sum(rating_score) AS score FROM reviews GROUP BY 1) ON key = p.asin) """ + " UNION ALL ".join([
    _level("all", []), _level("category", ["category"]), _level("niche", ["category", "niche"]), _level("family", ["category", "niche", "parent_asin"])]) + ")", ["products", "reviews"])
def _(t):
    return levels.catalogue_levels(t.products, t.reviews).withColumn("avg_rating", F.round("avg_rating", 6))


def _near(estimate, exact, error: float):
    return F.abs(estimate - exact) <= F.greatest(exact * error, F.lit(1))


@query("sketched_authors", """SELECT category, count(DISTINCT author_name || variation_text || child_asin) AS exact, true AS near
    FROM reviews JOIN (SELECT asin, category FROM products) p ON p.asin = reviews.child_asin GROUP BY 1""", ["reviews", "products"])
def _(t):
    """Different buyers of a variation per category: from sketches of days, next to the exact count."""
    rows = t.reviews.join(t.products.select(F.col("asin").alias("child_asin"), "category"), "child_asin").withColumn("who", F.concat("author_name", "variation_text", "child_asin"))
    found = sketches.merged(sketches.daily(rows, ["category"], "review_date", "who"), ["category"]).select("category", sketches.different("hll").alias("estimate"))
    exact = rows.groupBy("category").agg(F.count_distinct("who").alias("exact"))
    return exact.join(found, "category").select("category", "exact", _near(F.col("estimate"), F.col("exact"), sketches.DISTINCT_ERROR).alias("near"))


@query("sketched_overlap", """SELECT line, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE b AND NOT a) AS right_only, true AS near
    FROM (SELECT l_linenumber AS line, l_orderkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_linestatus = 'O') AS b FROM lineitem GROUP BY 1, 2) WHERE a OR b GROUP BY 1""")
def _(t):
    """Orders in two sources of rows, by line: the overlap of their sets from sketches of days, next to the exact one."""
    rows = t.raw("lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), "l_returnflag", "l_linestatus")
    sides = [sketches.merged(sketches.daily(rows.filter(c), ["line"], "ts", "id"), ["line"]) for c in ("l_returnflag = 'R'", "l_linestatus = 'O'")]
    found = sketches.overlap(*sides, ["line"])
    held = rows.groupBy("line", "id").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"))
    a, b = F.col("a"), F.col("b")
    exact = held.groupBy("line").agg(F.count_if(a & ~b).alias("l"), F.count_if(a & b).alias("s"), F.count_if(b & ~a).alias("r"))
    # the error of each part is a share of the whole union
    union = F.col("l") + F.col("s") + F.col("r")
    near = lambda e, x: F.abs(F.col(e) - F.col(x)) <= F.greatest(union * sketches.DISTINCT_ERROR * 2, F.lit(1))
    return exact.join(found, "line").select("line", F.col("l").alias("left_only"), F.col("s").alias("shared"), F.col("r").alias("right_only"), (near("left_only", "l") & near("shared", "s") & near("right_only", "r")).alias("near"))


@query("sketched_median", """SELECT platform, count(*) AS posts, true AS near FROM posts GROUP BY 1""", ["posts"])
def _(t):
    """The median of views per platform from sketches of days: its exact rank is near the middle."""
    posts = t.social_posts
    found = sketches.merged(sketches.daily(posts, ["platform"], "created_at", number="views"), ["platform"]).select("platform", sketches.quantile("kll", 0.5).alias("median"))
    ranks = posts.join(found, "platform").groupBy("platform").agg(F.count("*").alias("posts"), F.count_if(F.col("views") < F.col("median")).alias("below"), F.count_if(F.col("views") <= F.col("median")).alias("upto"))
    n = F.col("posts")
    near = (F.col("below") <= n * (0.5 + sketches.RANK_ERROR) + 1) & (F.col("upto") >= n * (0.5 - sketches.RANK_ERROR) - 1)
    return ranks.select("platform", "posts", near.alias("near"))


#: What the normaliser of one platform reads.
FACEBOOK = {
    "date": "string", "postId": "string", "id": "string", "postText": "string", "text": "string", "__typename": "string", "author.name": "string", "user.name": "string",
    "like_count": "bigint", "play_count": "bigint", "shares": "bigint", "url": "string",
}


def feed(t):
    """The records of ``normalise_facebook`` as JSON lines in changing shapes: counts as text or with a comma, an author as a list, a new field, lines that are no records."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("a"), user))
    author = F.when(n % 7 == 0, F.to_json(F.array(F.struct(name.alias("name"))))).otherwise(F.to_json(F.struct(name.alias("name"))))
    count = lambda c: F.when(n % 5 == 1, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).when((n % 5 == 2) & (c >= 1000), F.concat(F.lit('"'), F.format_number(c, 0), F.lit('"'))).otherwise(c.cast("string"))
    plain = F.struct(
        F.when(n % 6 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"), F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("postId"), n.alias("id"),
        F.when(n % 4 == 0, F.concat(F.lit("post "), "event_type")).alias("postText"), F.when(n % 4 == 1, F.col("event_type")).alias("text"),
        F.when(n % 2 == 1, "Video").otherwise("Post").alias("__typename"), F.when(n % 3 == 1, F.struct(F.concat(F.lit("u"), user).alias("name"))).alias("user"),
        F.concat(F.lit("http://f/"), n.cast("string")).alias("url"), F.when(n % 11 == 0, F.struct(F.lit("new").alias("mood"))).alias("reactions"),
    )
    like = F.when(n % 5 == 0, F.floor(F.col("value") * 2)).otherwise(0)
    record = F.concat(
        F.expr("''"), F.regexp_replace(F.to_json(plain), r"\}$", ""), F.lit(', "author": '), author, F.lit(', "like_count": '), count(like),
        F.lit(', "play_count": '), count(F.floor("value")), F.lit(', "shares": '), count(F.floor(F.col("value") / 2)), F.lit("}"),
    )
    good = t.raw("events").select(record.alias("value"))
    bad = t.raw("events").select(F.concat(F.lit("<html>"), n.cast("string")).alias("value"))
    return good.union(bad)


@query("variant_feed", QUERIES["normalise_facebook"].oracle)
def _(t):
    records = variants.read_lines(feed(t))
    return social.normalise_facebook(variants.shaped(records, FACEBOOK), "kw").select(*_POST, "created_at")


@query("variant_drift", """SELECT * FROM (WITH e AS (SELECT event_id AS n, CAST(floor(value) AS BIGINT) AS v, CAST(floor(value / 2) AS BIGINT) AS h, CASE WHEN event_id % 5 = 0 THEN CAST(floor(value * 2) AS BIGINT) ELSE 0 END AS l FROM events),
    p AS (SELECT unnest([
        {'path': 'date', 'seen': CASE WHEN n % 6 <> 0 THEN 'STRING' END}, {'path': 'postId', 'seen': 'STRING'}, {'path': 'id', 'seen': 'BIGINT'}, {'path': 'postText', 'seen': CASE WHEN n % 4 = 0 THEN 'STRING' END},
        {'path': 'text', 'seen': CASE WHEN n % 4 = 1 THEN 'STRING' END}, {'path': '__typename', 'seen': 'STRING'}, {'path': 'user', 'seen': CASE WHEN n % 3 = 1 THEN 'OBJECT' END},
        {'path': 'user.name', 'seen': CASE WHEN n % 3 = 1 THEN 'STRING' END}, {'path': 'url', 'seen': 'STRING'}, {'path': 'reactions', 'seen': CASE WHEN n % 11 = 0 THEN 'OBJECT' END},
        {'path': 'author', 'seen': CASE WHEN n % 7 = 0 THEN 'ARRAY' ELSE 'OBJECT' END}, {'path': 'author.name', 'seen': CASE WHEN n % 3 = 0 THEN 'STRING' END},
        {'path': 'like_count', 'seen': CASE WHEN n % 5 = 1 OR (n % 5 = 2 AND l >= 1000) THEN 'STRING' ELSE 'BIGINT' END}, {'path': 'play_count', 'seen': CASE WHEN n % 5 = 1 OR (n % 5 = 2 AND v >= 1000) THEN 'STRING' ELSE 'BIGINT' END},
        {'path': 'shares', 'seen': CASE WHEN n % 5 = 1 OR (n % 5 = 2 AND h >= 1000) THEN 'STRING' ELSE 'BIGINT' END}], recursive := true) FROM e)
    SELECT path, seen, count(*) AS records, CASE WHEN path = 'reactions' THEN 'new' WHEN path IN ('id', 'like_count', 'play_count', 'shares') AND (path = 'id') = (seen = 'BIGINT') OR seen = 'ARRAY' THEN 'other type' ELSE 'expected' END AS status
    FROM p WHERE seen IS NOT NULL GROUP BY 1, 2)""")
def _(t):
    return variants.drift(variants.read_lines(feed(t)), FACEBOOK)


@query("variant_rejects", "SELECT '<html>' || event_id AS value FROM events")
def _(t):
    return variants.unreadable(variants.read_lines(feed(t)))
