"""Registered queries: social feeds, spend and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import social, stats
from reviewatlas.plans.fixtures import _PLATFORM
from reviewatlas.plans.registry import query

_POST = ["platform", "post_id", "keyword", "author", "text", "url", "likes", "shares", "comments_count", "views"]


@query("normalise_facebook", """
    SELECT 'facebook' AS platform, CAST(event_id AS VARCHAR) AS post_id, 'kw' AS keyword,
      CASE WHEN event_id % 3 = 0 THEN 'a' || user_id WHEN event_id % 3 = 1 THEN 'u' || user_id END AS author,
      CASE WHEN event_id % 4 = 0 THEN 'post ' || event_type WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 2 = 0 THEN NULL ELSE '[Video/Reel Media]' END AS text,
      'http://f/' || event_id AS url, CASE WHEN event_id % 5 = 0 THEN CAST(floor(value * 2) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS likes,
      CAST(floor(value / 2) AS BIGINT) AS shares, CAST(0 AS BIGINT) AS comments_count, CAST(0 AS BIGINT) AS views,
      CASE WHEN event_id % 6 <> 0 THEN date_trunc('second', ts) END AS created_at
    FROM events""")
def _(t):
    e, n = F.col("event_id"), F.col("event_id")
    user = F.col("user_id").cast("string")
    raw = t.raw("events").select(
        F.when(n % 6 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(n % 2 == 0, e.cast("string")).otherwise("").alias("postId"), e.alias("id"),
        F.when(n % 4 == 0, F.concat(F.lit("post "), "event_type")).alias("postText"), F.when(n % 4 == 1, F.col("event_type")).alias("text"),
        F.when(n % 2 == 1, "Video").otherwise("Post").alias("__typename"),
        F.struct(F.when(n % 3 == 0, F.concat(F.lit("a"), user)).alias("name")).alias("author"),
        F.when(n % 3 == 1, F.struct(F.concat(F.lit("u"), user).alias("name"))).alias("user"),
        F.when(n % 5 == 0, F.floor(F.col("value") * 2)).otherwise(0).alias("like_count"), F.floor("value").alias("play_count"),
        F.floor(F.col("value") / 2).alias("shares"), F.concat(F.lit("http://f/"), e.cast("string")).alias("url"),
    )
    return social.normalise_facebook(raw, "kw").select(*_POST, "created_at")


@query("normalise_instagram", """SELECT 'instagram' AS platform, CAST(event_id AS VARCHAR) AS post_id, event_type AS keyword, 'u' || user_id AS author, event_type AS text,
    'http://i/' || event_id AS url, CAST(floor(value) AS BIGINT) AS likes, CAST(NULL AS BIGINT) AS shares, CAST(0 AS BIGINT) AS comments_count, CAST(NULL AS BIGINT) AS views, ts AS created_at FROM events""")
def _(t):
    raw = t.raw("events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ownerUsername"), F.col("event_type").alias("caption"),
        F.floor("value").alias("likesCount"), F.concat(F.lit("http://i/"), F.col("event_id").cast("string")).alias("url"), F.col("ts").alias("timestamp"),
    )
    return social.normalise_instagram(raw, F.col("caption")).select(*_POST, "created_at")


@query("normalise_tiktok", """SELECT 'tiktok' AS platform, CAST(event_id AS VARCHAR) AS post_id, 'kw' AS keyword, coalesce(nullif('u' || user_id, 'u3'), 'unknown') AS author,
    event_type AS text, 'https://www.tiktok.com/@' || coalesce(nullif('u' || user_id, 'u3'), 'unknown') || '/video/' || event_id AS url, CAST(0 AS BIGINT) AS likes,
    CAST(floor(value) AS BIGINT) AS shares, CAST(0 AS BIGINT) AS comments_count, CAST(floor(value * 1000) AS BIGINT) AS views, ts AS created_at FROM events""")
def _(t):
    name = F.when(F.col("user_id") != 3, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    raw = t.raw("events").select(
        F.col("event_id").alias("id"), F.struct(name.alias("name")).alias("channel"), F.col("event_type").alias("title"),
        F.floor(F.col("value") * 1000).alias("views"), F.floor("value").alias("shares"), F.lit("").alias("uploadedAtFormatted"),
        F.col("ts").cast("string").alias("uploadedAt"),
    )
    return social.normalise_tiktok(raw, "kw").select(*_POST, "created_at")


@query("normalise_comments", """SELECT platform, comment_id, post_url, author, text, likes, reply_count, created_at FROM (
    SELECT 'tiktok' AS platform, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE sha256('http://t/' || user_id || chr(31) || 'u' || user_id || chr(31) || event_type || event_id) END AS comment_id,
      'http://t/' || user_id AS post_url, 'u' || user_id AS author, event_type || event_id AS text, CAST(floor(value) AS BIGINT) AS likes, CAST(floor(value / 10) AS BIGINT) AS reply_count, to_timestamp(event_id)::TIMESTAMP AS created_at FROM events
    UNION ALL SELECT 'facebook', CAST(event_id AS VARCHAR), 'http://t/' || user_id, 'u' || user_id, event_type, 0, 0, ts FROM events)""")
def _(t):
    e = t.raw("events")
    eid, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    tiktok = e.select(
        F.when(F.col("event_id") % 2 == 0, eid).alias("id"), F.concat(F.lit("http://t/"), user).alias("videoWebUrl"), F.concat(F.lit("u"), user).alias("uniqueId"),
        F.concat("event_type", eid).alias("text"), F.floor("value").alias("diggCount"), F.floor(F.col("value") / 10).alias("replyCount"), F.col("event_id").alias("createTime"),
    )
    facebook = e.select(
        eid.alias("id"), F.concat(F.lit("http://t/"), user).alias("postUrl"), F.concat(F.lit("u"), user).alias("profileName"), F.col("event_type").alias("text"), F.col("ts").alias("date"),
    )
    both = social.normalise_comments(tiktok, "tiktok").unionByName(social.normalise_comments(facebook, "facebook"))
    return both.select("platform", "comment_id", "post_url", "author", "text", "likes", "reply_count", "created_at")


@query("normalise_ads", """SELECT CAST(event_id AS VARCHAR) AS ad_id, 'kw' AS keyword, 'page' || user_id AS page_name, event_type AS ad_body,
    CAST(ts AS DATE) AS start_date, CASE WHEN event_id % 2 = 0 THEN 'facebook, instagram' ELSE 'facebook' END AS platforms, 'meta_ads' AS platform,
    CASE WHEN event_id % 3 = 0 THEN 'SHOP' END AS cta_type, 'video' || event_id % 4 AS media_type, CAST(ts AS DATE) + 9 AS end_date, 'http://ads/' || event_id AS url FROM events""")
def _(t):
    raw = t.raw("events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("page"), F.col("user_id").cast("string")).alias("pageName"), F.col("event_type").alias("adBody"),
        F.date_format("ts", "yyyy-MM-dd").alias("startDate"), F.when(F.col("event_id") % 3 == 0, "SHOP").alias("ctaType"),
        F.concat(F.lit("video"), (F.col("event_id") % 4).cast("string")).alias("mediaType"), F.date_format(F.date_add("ts", 9), "yyyy-MM-dd").alias("endDate"),
        F.concat(F.lit("http://ads/"), F.col("event_id").cast("string")).alias("adSnapshotUrl"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("facebook"), F.lit("instagram"))).otherwise(F.array(F.lit("facebook"))).alias("publisherPlatforms"),
    )
    return social.normalise_ads(raw, "kw").select(
        "platform", "ad_id", "keyword", "page_name", "ad_body", "cta_type", "media_type", "start_date", "end_date", "platforms", "url"
    )


@query("repair_feed", "SELECT CAST(event_id AS VARCHAR) AS post_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text, value FROM events")
def _(t):
    feed = t.raw("events").select(
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("post_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("text"), "value",
    )
    return social.repair_feed(feed).select("post_id", "text", "value")


@query("estimate_cost", """SELECT event_id, round(floor(value) / 1000.0::DOUBLE * CASE WHEN user_id % 3 = 0 THEN 0.3 WHEN user_id % 3 = 1 THEN CASE WHEN event_type = 'view' THEN 1.5 ELSE 2.5 END ELSE 1.0 END::DOUBLE, 8) AS cost_usd FROM events""")
def _(t):
    rows = t.raw("events").withColumn("platform", F.expr(_PLATFORM)).select(
        "event_id", "platform", F.floor("value").alias("limit"), F.when(F.col("event_type") == "view", "comments").otherwise("feed").alias("task_type")
    )
    return social.estimate_cost(rows).select("event_id", F.round("cost_usd", 8).alias("cost_usd"))


@query("estimate_cost_with_fee", """SELECT event_id, round_even((CASE WHEN user_id % 4 = 0 THEN 0.0 + floor(value) / 1000::DOUBLE * 0.3::DOUBLE WHEN user_id % 4 = 1 THEN 0.5::DOUBLE + floor(value) / 1000::DOUBLE * 5
    WHEN user_id % 4 = 2 THEN 0.2::DOUBLE + floor(value) / 1000::DOUBLE * 3.5::DOUBLE ELSE 0 END) * 100, 0) / 100 AS estimated_cost FROM events""")
def _(t):
    keys = F.element_at(F.array(*[F.lit(k) for k in [*social.FEES, "OTHER"]]), (F.col("user_id") % 4 + 1).cast("int"))
    rows = t.raw("events").select("event_id", keys.alias("platform_key"), F.floor("value").alias("item_count"))
    return social.estimate_cost_with_fee(rows).select("event_id", "estimated_cost")


@query("spend_by_user", "SELECT user_id, round(sum(cost_usd), 6) AS current_spend, count(*) AS charges FROM charges WHERE cost_usd > 0 GROUP BY 1", ["charges"])
def _(t):
    return social.spend_by_user(t.charges).withColumn("current_spend", F.round("current_spend", 6))


_POSITION = """SELECT u.user_id, monthly_budget, round(spend, 6) AS current_spend, round(greatest(0, monthly_budget - spend), 6) AS remaining,
    round(least(1.0, spend / monthly_budget), 6) AS used_share, CASE WHEN spend / monthly_budget >= 0.9 THEN 'critical' WHEN spend / monthly_budget >= 0.75 THEN 'low' ELSE 'ok' END AS level
    FROM users u JOIN (SELECT user_id, sum(cost_usd) AS spend FROM charges WHERE cost_usd > 0 GROUP BY 1) w ON w.user_id = u.user_id"""


@query("budget_position", _POSITION, ["users", "charges"])
def _(t):
    out = social.budget_position(t.users, social.spend_by_user(t.charges).drop("charges"))
    for c in ("current_spend", "remaining", "used_share"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("affordable", f"""SELECT c.log_id, coalesce(p.remaining, 0) >= cost_usd AS accepted FROM charges c LEFT JOIN ({_POSITION}) p ON p.user_id = c.user_id""", ["users", "charges"])
def _(t):
    positions = social.budget_position(t.users, social.spend_by_user(t.charges).drop("charges")).withColumn("remaining", F.round("remaining", 6))
    return social.affordable(t.charges, positions).select("log_id", "accepted")


# posts without an author, posts without views, and an author without any views
_GAPS = """SELECT * REPLACE (CASE WHEN CAST(post_id AS BIGINT) % 13 = 0 THEN NULL ELSE author END AS author,
      CASE WHEN CAST(post_id AS BIGINT) % 11 = 0 OR author LIKE '%7' THEN NULL ELSE views END AS views) FROM posts"""


def _gaps(t):
    number = F.col("post_id").cast("bigint")
    return t.social_posts.withColumns({
        "author": F.when(number % 13 != 0, F.col("author")), "views": F.when((number % 11 != 0) & ~F.endswith("author", F.lit("7")), F.col("views")),
    })


@query("relative_spike", f"""SELECT post_id, round(views / median_views, 6) AS spike, coalesce(views / median_views >= 3, false) AS is_viral FROM ({_GAPS}) p
    LEFT JOIN (SELECT author AS a, median(views)::DOUBLE AS median_views FROM ({_GAPS}) GROUP BY 1) m ON p.author = m.a""", ["posts"])
def _(t):
    return social.relative_spike(_gaps(t)).select("post_id", F.round("spike", 6).alias("spike"), "is_viral")


@query("posting_rhythm", """SELECT author, posts, round(h, 6) AS avg_gap_hours, CASE WHEN h < 24 THEN 'burst' WHEN h BETWEEN 24 AND 72 THEN 'machine' WHEN h > 168 THEN 'sniper' ELSE 'other' END AS rhythm
    FROM (SELECT author, count(*) AS posts, CASE WHEN count(*) > 1 THEN (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600000000.0::DOUBLE / (count(*) - 1) END AS h
          FROM (SELECT * REPLACE (author || keyword AS author) FROM posts) GROUP BY 1)""", ["posts"])
def _(t):
    finer = t.social_posts.withColumn("author", F.concat("author", "keyword"))
    return social.posting_rhythm(finer).withColumn("avg_gap_hours", F.round("avg_gap_hours", 6))


@query("bursts", """SELECT author, run, min(created_at) AS first_post, max(created_at) AS last_post, count(*) AS posts, CAST(sum(views) AS BIGINT) AS total_views,
      arg_max(post_id, (views, post_id)) AS best_post, max(views) AS best_views
    FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY author ORDER BY created_at, post_id) AS BIGINT) AS run
          FROM (SELECT *, CASE WHEN epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY author ORDER BY created_at, post_id) < 24 * 3600000000 THEN 0 ELSE 1 END AS fresh
                FROM (SELECT * REPLACE (author || keyword AS author) FROM posts)))
    GROUP BY 1, 2""", ["posts"])
def _(t):
    finer = t.social_posts.withColumn("author", F.concat("author", "keyword"))
    return social.bursts(finer)


def _comments(t):
    """Even events are roots, odd ones answer the event before them."""
    e = F.col("event_id")
    return t.raw("events").select(
        F.concat(F.lit("p"), (F.floor(e / 2) % 40).cast("string")).alias("post_url"), e.cast("string").alias("comment_id"),
        F.when(e % 2 == 1, (e - 1).cast("string")).alias("parent_id"), F.floor("value").alias("likes"),
    )


@query("top_threads", """SELECT * FROM (WITH c AS (SELECT 'p' || (event_id // 2 % 40) AS post_url, CAST(event_id AS VARCHAR) AS comment_id, CASE WHEN event_id % 2 = 1 THEN CAST(event_id - 1 AS VARCHAR) END AS parent_id, CAST(floor(value) AS BIGINT) AS likes FROM events),
    h AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY post_url ORDER BY likes DESC, comment_id) AS INTEGER) AS root_rank FROM c WHERE parent_id IS NULL) WHERE root_rank <= 10),
    a AS (SELECT * FROM (SELECT c.*, h.root_rank, CAST(row_number() OVER (PARTITION BY c.post_url, c.parent_id ORDER BY c.likes DESC, c.comment_id) AS INTEGER) AS reply_rank FROM c JOIN h ON h.post_url = c.post_url AND h.comment_id = c.parent_id) WHERE reply_rank <= 3)
    SELECT *, 0 AS reply_rank FROM h UNION ALL SELECT * FROM a)""")
def _(t):
    return social.top_threads(_comments(t))


@query("velocity", """SELECT post_id, scanned_at, views, gained, round(gained / ((epoch_us(scanned_at) - epoch_us(prev)) / 3600000000.0::DOUBLE), 6) AS views_per_hour FROM (
    SELECT author AS post_id, created_at AS scanned_at, views, views - lag(views) OVER w AS gained, lag(created_at) OVER w AS prev FROM posts WINDOW w AS (PARTITION BY author ORDER BY created_at, views)) WHERE prev IS NOT NULL""", ["posts"])
def _(t):
    scans = t.social_posts.select(F.col("author").alias("post_id"), F.col("created_at").alias("scanned_at"), "views")
    return social.velocity(scans).withColumn("views_per_hour", F.round("views_per_hour", 6))


NOW = "2024-01-31 00:00:00"


@query("tracking_tier", f"""SELECT post_id, CASE WHEN age <= 3 THEN 'daily' WHEN age <= 7 THEN 'every_3_days' WHEN age <= 30 THEN 'weekly' ELSE 'archive' END AS tier
    FROM (SELECT post_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE AS age FROM posts)""", ["posts"])
def _(t):
    return social.tracking_tier(t.social_posts, F.to_timestamp(F.lit(NOW)))


@query("viral_score", """SELECT post_id, author, round(coalesce(shares::DOUBLE / nullif(views, 0), 0), 8) AS score, coalesce(shares::DOUBLE / nullif(views, 0), 0) > 0.01 AS winning FROM posts""", ["posts"])
def _(t):
    return social.viral_score(t.social_posts).withColumn("score", F.round("score", 8))


@query("hashtags", "SELECT lower(tag) AS tag, count(*) AS posts, CAST(sum(views) AS BIGINT) AS views FROM (SELECT unnest(regexp_extract_all(text, '#(\\w+)', 1)) AS tag, views FROM posts WHERE views > 30000) GROUP BY 1", ["posts"])
def _(t):
    return social.hashtags(t.social_posts, 30000)


@query("trending_audio", "SELECT props::JSON->>'k' AS music, count(*) AS posts FROM events WHERE value * 1000 > 30000 GROUP BY 1")
def _(t):
    posts = t.raw("events").select(F.get_json_object("props", "$.k").alias("music"), (F.col("value") * 1000).alias("views"))
    return social.trending_audio(posts, 30000)


@query("latest_posts", "SELECT author, post_id, views, created_at FROM posts QUALIFY row_number() OVER (PARTITION BY author ORDER BY created_at DESC, post_id) <= 10", ["posts"])
def _(t):
    return social.latest_posts(t.social_posts)


@query("ad_longevity", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_name ORDER BY duration_days DESC, ad_id) AS INTEGER) AS rank FROM (
      SELECT *, date_diff('day', start_date, CASE WHEN is_active THEN DATE '2024-03-01' ELSE coalesce(end_date, DATE '2024-03-01') END) AS duration_days FROM (
        SELECT CAST(event_id AS VARCHAR) AS ad_id, 'page' || user_id AS page_name, CAST(ts AS DATE) AS start_date, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 60 AS INTEGER) END AS end_date, event_id % 3 = 0 AS is_active FROM events))
    WHERE is_active OR duration_days > 30) WHERE rank <= 20""")
def _(t):
    e, day = F.col("event_id"), F.to_date("ts")
    ads = t.raw("events").select(
        e.cast("string").alias("ad_id"), F.concat(F.lit("page"), F.col("user_id").cast("string")).alias("page_name"), day.alias("start_date"),
        F.when(e % 3 != 0, F.date_add(day, (e % 60).cast("int"))).alias("end_date"), (e % 3 == 0).alias("is_active"),
    )
    out = social.ad_longevity(ads, F.to_date(F.lit("2024-03-01")))
    return out.withColumn("duration_days", F.col("duration_days").cast("bigint"))


@query("keep_posts", f"""SELECT post_id, views, tagged AND (text LIKE '%disappointed%' OR text LIKE '%returned%') AS alert FROM (
    SELECT *, CAST(post_id AS BIGINT) % 10 = 0 AS tagged FROM (SELECT * REPLACE (CASE WHEN keyword = 'error' THEN text || ' Returned it' ELSE text END AS text) FROM posts))
    , (SELECT 1) WHERE views > 50000 OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE < 7 OR tagged""".replace("text LIKE", "lower(text) LIKE"), ["posts"])
def _(t):
    text = F.when(F.col("keyword") == "error", F.concat("text", F.lit(" Returned it"))).otherwise(F.col("text"))
    posts = t.social_posts.withColumn("text", text).withColumn("is_tagged", F.col("post_id").cast("bigint") % 10 == 0)
    return social.keep_posts(posts, F.to_timestamp(F.lit(NOW)))


@query("safe_buy_score", "SELECT asin, round((b4 + b5) * 100 / bsum, 6) AS safe_buy_score FROM bd WHERE NOT missing", ["bd"])
def _(t):
    return social.safe_buy_score(stats.official_stars(t.products)).withColumn("safe_buy_score", F.round("safe_buy_score", 6))


@query("trend_bridge", """SELECT n.tag, n.aspect, n.mentions, s.posts AS social_posts, s.views AS social_views FROM
    (SELECT lower(trim(raw)) AS tag, aspect, count(*) AS mentions FROM tags_norm GROUP BY 1, 2) n
    JOIN (SELECT lower(tag) AS tag, count(*) AS posts, CAST(sum(views) AS BIGINT) AS views FROM (SELECT unnest(regexp_extract_all(text, '#(\\w+)', 1)) AS tag, views
          FROM (SELECT CASE WHEN CAST(post_id AS BIGINT) % 3 <> 0 THEN views END AS views, text || ' #' || split_part(p_name, ' ', 2) AS text FROM posts JOIN part ON p_partkey = CAST(post_id AS BIGINT) % (SELECT count(*) FROM part))) GROUP BY 1) s ON s.tag = n.tag""", ["tags_norm", "posts"])
def _(t):
    parts = t.raw("part").agg(F.count("*")).scalar()
    names = t.raw("part").select(F.col("p_partkey").alias("_p"), F.split("p_name", " ")[1].alias("_w"))
    posts = t.social_posts.join(names, F.col("post_id").cast("bigint") % parts == F.col("_p")).withColumn("text", F.concat("text", F.lit(" #"), "_w"))
    posts = posts.withColumn("views", F.when(F.col("post_id").cast("bigint") % 3 != 0, F.col("views")))
    return social.trend_bridge(t.review_tags, t.aspect_mapping, posts)


def _recent(t):
    """Reviews moved to the years of the posts."""
    return t.reviews.withColumn("review_date", F.add_months("review_date", 12 * 28))


_MONTHS = """SELECT coalesce(s.month, r.month) AS month, coalesce(posts, 0) AS posts, coalesce(reviews, 0) AS reviews
    FROM (SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS posts FROM posts GROUP BY 1) s
    FULL JOIN (SELECT CAST(date_trunc('month', review_date + INTERVAL 28 YEAR) AS DATE) AS month, count(*) AS reviews FROM reviews GROUP BY 1) r ON r.month = s.month"""


@query("volume_by_month", _MONTHS, ["posts", "reviews"])
def _(t):
    return social.volume_by_month(t.social_posts, _recent(t))


@query("volume_correlation", f"SELECT round(corr(posts, reviews), 6) AS correlation, count(*) AS periods FROM ({_MONTHS})", ["posts", "reviews"])
def _(t):
    out = social.volume_correlation(social.volume_by_month(t.social_posts, _recent(t)), "posts", "reviews")
    return out.withColumn("correlation", F.round("correlation", 6))


@query("event_counts", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1, 2")
def _(t):
    return social.event_counts(t.raw("events"))
