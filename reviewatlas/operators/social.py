"""Social posts, comments and ads: normalising, trends, rhythm, spend and budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from reviewatlas.functions.columns import blank_to_null, norm
from reviewatlas.functions.frames import exact_median, previous_rows, top_k
from reviewatlas.schemas import conform

# USD per 1000 items by (platform, task), and per platform key with a base fee.
RATES = {
    ("tiktok", "feed"): 0.30, ("tiktok", "comments"): 0.30,
    ("facebook", "feed"): 2.50, ("facebook", "comments"): 1.50,
}
OTHER_RATE = 1.00
FEES = {"TIKTOK_FEED": (0.30, 0.0), "FB_ADS": (5.00, 0.50), "INSTA_POSTS": (3.50, 0.20)}
NEGATIVE_WORDS = ["disappointed", "returned"]


def _micros(c: Column | str) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _type_at(schema: DataType, path: str) -> DataType | None:
    for name in path.split("."):
        if not isinstance(schema, StructType) or name not in schema.names:
            return None
        schema = schema[name].dataType
    return schema


def field(df: DataFrame, path: str, cast: str = "string") -> Column:
    """A (nested) field, or a typed null when the batch does not have it."""
    if _type_at(df.schema, path) is None:
        return F.lit(None).cast(cast)
    return F.col(path).try_cast(cast)


def _text(df: DataFrame, *paths: str) -> Column:
    """First field that holds text."""
    return F.coalesce(*[blank_to_null(field(df, p)) for p in paths])


def _count(df: DataFrame, *paths: str) -> Column:
    """First non-zero count; the zero of the last known field otherwise."""
    found = [F.nullif(field(df, p, "bigint"), F.lit(0)) for p in paths]
    return F.coalesce(*found, F.lit(0).cast("bigint"))


def normalise_facebook(raw: DataFrame, keyword: str | Column) -> DataFrame:
    text = _text(raw, "postText", "content", "text")
    silent = F.when(text.isNull() & (field(raw, "__typename") == "Video"), "[Video/Reel Media]")
    return conform(raw.select(
        F.lit("facebook").alias("platform"), F.coalesce(_text(raw, "postId", "id"), F.lit("None")).alias("post_id"),
        F.lit(keyword).alias("keyword"), _text(raw, "author.name", "user.name", "video_owner.name").alias("author"),
        F.coalesce(text, silent).alias("text"),
        _count(raw, "like_count", "reactionsCount", "likes", "play_count").alias("likes"),
        _count(raw, "comment_count", "commentsCount", "comments").alias("comments_count"),
        _count(raw, "share_count", "shares").alias("shares"), F.lit(0).alias("views"),
        _text(raw, "permalink", "permalink_url", "url", "postUrl").alias("url"),
        _text(raw, "date", "time", "timestamp").alias("created_at"),
    ), "social_posts")


def normalise_instagram(raw: DataFrame, keyword: str | Column) -> DataFrame:
    return conform(raw.select(
        F.lit("instagram").alias("platform"), field(raw, "id").alias("post_id"), F.lit(keyword).alias("keyword"),
        field(raw, "ownerUsername").alias("author"), field(raw, "caption").alias("text"),
        F.coalesce(field(raw, "likesCount", "bigint"), F.lit(0)).alias("likes"),
        F.coalesce(field(raw, "commentsCount", "bigint"), F.lit(0)).alias("comments_count"),
        field(raw, "url").alias("url"), field(raw, "timestamp").alias("created_at"),
    ), "social_posts")


def normalise_tiktok(raw: DataFrame, keyword: str | Column) -> DataFrame:
    author = F.coalesce(_text(raw, "channel.name"), F.lit("unknown"))
    link = F.concat(F.lit("https://www.tiktok.com/@"), author, F.lit("/video/"), F.coalesce(field(raw, "id"), F.lit("None")))

    def count(name: str) -> Column:
        return F.coalesce(field(raw, name, "bigint"), F.lit(0))

    return conform(raw.select(
        F.lit("tiktok").alias("platform"), field(raw, "id").alias("post_id"), F.lit(keyword).alias("keyword"),
        author.alias("author"), field(raw, "title").alias("text"), count("views").alias("views"), count("likes").alias("likes"),
        count("shares").alias("shares"), count("comments").alias("comments_count"),
        _text(raw, "uploadedAtFormatted", "uploadedAt").alias("created_at"), link.alias("url"),
    ), "social_posts")


def normalise_comments(raw: DataFrame, platform: str) -> DataFrame:
    """Comments of one platform; a missing id becomes a hash of the content, so reruns agree."""
    if platform == "tiktok":
        url, author, likes = field(raw, "videoWebUrl"), field(raw, "uniqueId"), field(raw, "diggCount", "bigint")
        replies = field(raw, "replyCount", "bigint")
        epoch = F.coalesce(field(raw, "createTime", "bigint"), F.lit(0))
        created = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=epoch)
    elif platform == "facebook":
        url, author = field(raw, "postUrl"), field(raw, "profileName")
        likes, replies = F.coalesce(field(raw, "likesCount", "bigint"), F.lit(0)), F.lit(0)
        created = field(raw, "date", "timestamp_ntz")
    else:
        raise ValueError(f"no comment layout for {platform!r}")
    text = field(raw, "text")
    made = F.sha2(F.concat_ws("\x1f", F.coalesce(url, F.lit("")), F.coalesce(author, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    return conform(raw.select(
        F.coalesce(blank_to_null(field(raw, "id")), made).alias("comment_id"), url.alias("post_url"),
        F.lit(platform).alias("platform"), author.alias("author"), text.alias("text"), likes.alias("likes"),
        replies.alias("reply_count"), created.alias("created_at"),
    ), "social_comments")


def normalise_ads(raw: DataFrame, keyword: str | Column) -> DataFrame:
    shown = _type_at(raw.schema, "publisherPlatforms")
    where = F.array_join("publisherPlatforms", ", ") if shown is not None else F.lit("")
    return conform(raw.select(
        F.lit("meta_ads").alias("platform"), field(raw, "id").alias("ad_id"), F.lit(keyword).alias("keyword"),
        field(raw, "pageName").alias("page_name"), field(raw, "adBody").alias("ad_body"), field(raw, "ctaType").alias("cta_type"),
        field(raw, "mediaType").alias("media_type"), field(raw, "startDate").alias("start_date"),
        field(raw, "endDate").alias("end_date"), where.alias("platforms"), field(raw, "adSnapshotUrl").alias("url"),
    ), "social_ads")


def repair_feed(df: DataFrame) -> DataFrame:
    """A feed read back from CSV: ids under either name, missing values as empty text."""
    have = set(df.columns)
    ids = [F.col(c).cast("string") for c in ("post_id", "id") if c in have]
    df = df.withColumn("post_id", F.coalesce(*ids)) if ids else df
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.na.fill("", texts)


# --- cost, spend and budget ---------------------------------------------------------------


def _lookup(key: Column, table: Mapping[str, float], default: float | None) -> Column:
    """A fixed small table as an expression: no join."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def estimate_cost(requests: DataFrame, rates: Mapping[tuple[str, str], float] = RATES, other: float = OTHER_RATE) -> DataFrame:
    """Price of ``limit`` items by platform and task; tasks other than comments are feeds."""
    task = F.when(F.col("task_type") == "comments", "comments").otherwise("feed")
    rate = _lookup(F.concat_ws("/", "platform", task), {"/".join(k): v for k, v in rates.items()}, other)
    return requests.withColumn("cost_usd", F.col("limit") / 1000.0 * rate)


def estimate_cost_with_fee(requests: DataFrame, fees: Mapping[str, tuple[float, float]] = FEES) -> DataFrame:
    """Base fee plus unit price per 1000 items, to cents (half to even); unknown platforms cost
    nothing."""
    unit = _lookup(F.col("platform_key"), {k: v[0] for k, v in fees.items()}, None)
    base = _lookup(F.col("platform_key"), {k: v[1] for k, v in fees.items()}, None)
    total = F.rint((base + F.col("item_count") / 1000 * unit) * 100) / 100
    return requests.withColumn("estimated_cost", F.coalesce(total, F.lit(0.0)))


def spend_by_user(charges: DataFrame) -> DataFrame:
    """Spend per user from the charge log; charges of zero or less do not count."""
    paid = charges.filter(F.col("cost_usd") > 0)
    return paid.groupBy("user_id").agg(F.sum("cost_usd").alias("current_spend"), F.count("*").alias("charges"))


def budget_position(users: DataFrame, wallets: DataFrame, warn: float = 0.75, critical: float = 0.9) -> DataFrame:
    """Remaining budget, used share and alert level of every user with a wallet."""
    budget, spend = F.col("monthly_budget"), F.col("current_spend")
    used = F.when(budget > 0, F.least(F.lit(1.0), spend / budget)).otherwise(0.0)
    level = F.when(used >= critical, "critical").when(used >= warn, "low").otherwise("ok")
    return users.join(wallets, "user_id").select(
        "user_id", "monthly_budget", "current_spend", F.greatest(F.lit(0.0), budget - spend).alias("remaining"),
        used.alias("used_share"), level.alias("level"),
    )


def affordable(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """Requests (``user_id, cost_usd``) with whether the remaining budget covers each; users
    without a wallet have nothing."""
    left = positions.select("user_id", "remaining")
    return requests.join(left, "user_id", "left").withColumn(
        "accepted", F.coalesce("remaining", F.lit(0.0)) >= F.col("cost_usd")
    ).drop("remaining")


# --- trends -------------------------------------------------------------------------------


def relative_spike(posts: DataFrame, factor: float = 3.0) -> DataFrame:
    """Views against the author's median. Posts without an author or views, and those of authors without any views, stay and are not viral."""
    named = posts.filter(F.col("author").isNotNull())
    median = exact_median(named, "author", "views", "median_views")
    ratio = F.try_divide(F.col("views"), F.col("median_views"))
    return posts.join(median, "author", "left").withColumn("spike", ratio).withColumn(
        "is_viral", F.coalesce(ratio >= factor, F.lit(False))
    )


def posting_rhythm(posts: DataFrame) -> DataFrame:
    """Mean hours between an author's posts: (last - first) / (n - 1), so no ordering is needed."""
    spans = posts.groupBy("author").agg(
        F.count("*").alias("posts"), F.min("created_at").alias("_first"), F.max("created_at").alias("_last")
    )
    micros = _micros("_last") - _micros("_first")
    hours = F.when(F.col("posts") > 1, micros / 3.6e9 / (F.col("posts") - 1))
    band = (
        F.when(hours < 24, "burst").when(hours.between(24, 72), "machine").when(hours > 168, "sniper").otherwise("other")
    )
    return spans.select("author", "posts", hours.alias("avg_gap_hours"), band.alias("rhythm"))


def bursts(posts: DataFrame, gap_hours: int = 24) -> DataFrame:
    """Runs of posts whose gaps stay below ``gap_hours``: totals and best post of each run.

    Posts inside one cell of ``gap_hours`` are always in the same run, so they are aggregated
    first; the ordering window then sees at most one row per author and cell.
    """
    micros = gap_hours * 3_600_000_000
    best = F.struct(F.col("views"), F.col("post_id"))
    cells = posts.groupBy("author", F.floor(_micros("created_at") / micros).alias("_cell")).agg(
        F.min("created_at").alias("_lo"), F.max("created_at").alias("_hi"), F.count("*").alias("_n"),
        F.sum("views").alias("_views"), F.max(best).alias("_best"),
    )
    w = Window.partitionBy("author").orderBy("_cell")
    gap = _micros("_lo") - _micros(F.lag("_hi").over(w))
    marked = cells.withColumn("_new", F.when(gap < micros, 0).otherwise(1))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("run", run).groupBy("author", "run").agg(
            F.min("_lo").alias("first_post"), F.max("_hi").alias("last_post"), F.sum("_n").alias("posts"),
            F.sum("_views").alias("total_views"), F.max("_best").alias("_best"),
        )
        .select("author", "run", "first_post", "last_post", "posts", "total_views",
                F.col("_best.post_id").alias("best_post"), F.col("_best.views").alias("best_views"))
    )


def top_threads(comments: DataFrame, roots: int = 10, replies: int = 3) -> DataFrame:
    """Most liked root comments of each post and the most liked replies of each of them.
    ``comments``: post_url, comment_id, parent_id (null for a root), likes."""
    order = [F.desc("likes"), F.asc("comment_id")]
    heads = top_k(comments.filter(F.col("parent_id").isNull()), "post_url", order, roots, rank="root_rank")
    below = comments.filter(F.col("parent_id").isNotNull()).join(
        heads.select("post_url", F.col("comment_id").alias("parent_id"), "root_rank"), ["post_url", "parent_id"]
    )
    answers = top_k(below, ["post_url", "parent_id"], order, replies, rank="reply_rank")
    return heads.withColumn("reply_rank", F.lit(0)).unionByName(answers)


def velocity(scans: DataFrame, cell_hours: int = 24) -> DataFrame:
    """Growth per hour between two scans of a post (``post_id, scanned_at, views``)."""
    moved = previous_rows(scans.select("post_id", "scanned_at", "views"), "post_id", "scanned_at", ["views"], cell_hours)
    hours = (_micros("scanned_at") - _micros("prev_scanned_at")) / 3.6e9
    return moved.filter(F.col("prev_scanned_at").isNotNull()).select(
        "post_id", "scanned_at", "views", (F.col("views") - F.col("prev_views")).alias("gained"),
        F.try_divide(F.col("views") - F.col("prev_views"), hours).alias("views_per_hour"),
    )


def tracking_tier(posts: DataFrame, now: Column, fresh: int = 3, stale: int = 7, stop: int = 30) -> DataFrame:
    """How often a post is scanned again, by its age in days at ``now``."""
    age = (_micros(now) - _micros("created_at")) / 8.64e10
    tier = F.when(age <= fresh, "daily").when(age <= stale, "every_3_days").when(age <= stop, "weekly").otherwise("archive")
    return posts.select("post_id", tier.alias("tier"))


def viral_score(posts: DataFrame, threshold: float = 0.01) -> DataFrame:
    score = F.coalesce(F.try_divide(F.col("shares"), F.col("views")), F.lit(0.0))
    return posts.select("post_id", "author", score.alias("score"), (score > threshold).alias("winning"))


def hashtags(posts: DataFrame, min_views: int | None = 100_000) -> DataFrame:
    """How often each hashtag occurs in posts seen often enough; without a floor in all posts, also those without views."""
    tags = F.explode(F.regexp_extract_all("text", F.lit(r"#(\w+)"), F.lit(1)))
    often = posts if min_views is None else posts.filter(F.col("views") > min_views)
    seen = often.select(tags.alias("tag"), "views")
    return seen.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("posts"), F.sum("views").alias("views"))


def trending_audio(posts: DataFrame, min_views: int = 100_000) -> DataFrame:
    """How often each music title occurs in posts seen often enough."""
    return posts.filter(F.col("views") > min_views).groupBy("music").agg(F.count("*").alias("posts"))


def latest_posts(posts: DataFrame, k: int = 10) -> DataFrame:
    return top_k(posts.select("author", "post_id", "views", "created_at"), "author", [F.desc("created_at"), F.asc("post_id")], k)


def ad_longevity(ads: DataFrame, today: Column, min_days: int = 30, k: int = 20) -> DataFrame:
    """Running or long-lived ads of every page, longest first."""
    running = F.col("is_active")
    days = F.date_diff(F.when(running, today).otherwise(F.coalesce("end_date", today)), "start_date")
    kept = ads.withColumn("duration_days", days).filter(running | (days > min_days))
    return top_k(kept, "page_name", [F.desc("duration_days"), F.asc("ad_id")], k, rank="rank")


def keep_posts(posts: DataFrame, now: Column, min_views: int = 50_000, days: int = 7) -> DataFrame:
    """Posts worth keeping (seen often, new, or tagged by customers) and an alert on bad words."""
    age = (_micros(now) - _micros("created_at")) / 8.64e10
    bad = F.lit(False)
    for word in NEGATIVE_WORDS:
        bad = bad | F.coalesce(F.lower("text").contains(word), F.lit(False))
    kept = (F.col("views") > min_views) | (age < days) | F.col("is_tagged")
    return posts.filter(kept).select("post_id", "views", (F.col("is_tagged") & bad).alias("alert"))


def safe_buy_score(official: DataFrame) -> DataFrame:
    """Share of 4 and 5 star ratings from the official histogram (long form)."""
    good = F.sum(F.when(F.col("star") >= 4, F.col("value")).otherwise(0.0))
    return official.groupBy("asin").agg(F.try_divide(good * 100, F.sum("value")).alias("safe_buy_score"))


def trend_bridge(tags: DataFrame, mapping: DataFrame, posts: DataFrame) -> DataFrame:
    """Standard aspects next to the hashtags of the same normalised name."""
    from reviewatlas.operators import aspects

    raw = tags.groupBy("parent_asin", F.col("aspect").alias("raw_aspect")).agg(F.count("*").alias("n"))
    named = aspects.resolve_aspects(raw, mapping, "norm").groupBy(norm("raw_aspect").alias("tag"), "aspect").agg(F.sum("n").alias("mentions"))
    social = hashtags(posts, None).select("tag", F.col("posts").alias("social_posts"), F.col("views").alias("social_views"))
    return named.join(social, "tag")


def volume_by_month(posts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Posts and reviews per month, side by side. ``month`` is its first day: equal months of different years are different periods."""
    social = posts.groupBy(F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("posts"))
    sold = reviews.groupBy(F.trunc("review_date", "month").alias("month")).agg(F.count("*").alias("reviews"))
    return social.join(sold, "month", "full").select(
        "month", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("reviews", F.lit(0)).alias("reviews")
    )


def volume_correlation(volumes: DataFrame, x: str, y: str) -> DataFrame:
    return volumes.agg(F.corr(x, y).alias("correlation"), F.count("*").alias("periods"))


def event_counts(events: DataFrame, columns: Sequence[str] = ("event_type",)) -> DataFrame:
    """Events per type and day."""
    return events.groupBy(*columns, F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
