"""Product statistics for all products in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions.columns import breakdown_map, map_total, star_value
from reviewatlas.functions.frames import spread, stored, top_k
from reviewatlas.operators import aspects

STARS = (1, 2, 3, 4, 5)


def sample_counts(reviews: DataFrame) -> DataFrame:
    """Per family: reviews in the sample, and per star ``n1`` .. ``n5``."""
    star = F.round("rating_score").cast("int")
    return reviews.groupBy("parent_asin").agg(
        F.count("*").alias("n"), *[F.count_if(star == s).alias(f"n{s}") for s in STARS]
    )


def product_kpis(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Official totals with the sample as fallback, one row per family."""
    sample = reviews.groupBy("parent_asin").agg(
        F.count("*").alias("n"),
        F.avg("rating_score").alias("avg_score"),
        F.count_distinct("child_asin").alias("children"),
    )
    return kpis_of(products, sample)


def kpis_of(products: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample`` has n, avg_score and children of each family."""
    official = products.select(
        "asin", F.col("parent_asin").alias("family"), "real_total_ratings", "real_average_rating",
        "variation_count", breakdown_map("rating_breakdown").alias("bd"),
    )
    both = sample.join(official, F.col("parent_asin") == F.col("asin"), "full").filter(
        F.col("n").isNotNull() | (F.col("asin") == F.col("family"))
    )
    unknown = F.col("asin").isNull()
    total = map_total(F.col("bd"))
    low = star_value(F.col("bd"), 1) + star_value(F.col("bd"), 2)
    listed = F.coalesce("variation_count", F.lit(0))
    return both.select(
        F.coalesce("parent_asin", "asin").alias("asin"),
        F.coalesce("real_total_ratings", "n", F.lit(0)).cast("bigint").alias("total_reviews"),
        F.coalesce("real_average_rating", "avg_score", F.lit(0.0)).alias("avg_rating"),
        F.when(unknown, 0).when(listed == 0, F.coalesce("children", F.lit(0))).otherwise(listed)
        .cast("bigint").alias("total_variations"),
        F.when(total > 0, low / total * 100).otherwise(0.0).alias("neg_pct"),
        unknown.alias("is_fallback"),
    )


def sample_kpis(reviews: DataFrame) -> DataFrame:
    n = F.count("*")
    return reviews.groupBy("parent_asin").agg(
        n.alias("total_reviews"),
        F.avg("rating_score").alias("avg_rating"),
        F.count_distinct("child_asin").alias("total_variations"),
        (F.count_if(F.col("is_verified")) * 100.0 / n).alias("verified_pct"),
        (F.count_if(F.col("rating_score") <= 2) * 100.0 / n).alias("negative_pct"),
    )


def live_kpis(parents: DataFrame, products: DataFrame) -> DataFrame:
    """KPIs without pre-computed statistics. The negative share is the plain sum of the
    document's 1 and 2 star values, each rounded, and counts as 0 when either is missing or beyond the integers."""
    one, two = (
        F.rint(F.get_json_object("rating_breakdown", f"$.{s}").try_cast("double")).try_cast("int").cast("bigint") for s in (1, 2)
    )
    official = products.select(
        F.col("asin").alias("parent_asin"), "real_total_ratings", "real_average_rating",
        "variation_count", "rating_breakdown",
    )
    return parents.select("parent_asin").join(official, "parent_asin", "left").select(
        "parent_asin",
        F.coalesce("real_total_ratings", F.lit(0)).cast("bigint").alias("total_reviews"),
        F.coalesce("real_average_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("variation_count", F.lit(0)).cast("bigint").alias("total_variations"),
        F.coalesce(one + two, F.lit(0)).cast("bigint").alias("negative_pct"),
    )


def population(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per family: total ratings in the market and the real reviews behind each star,
    with the sample counts (``n1``..``n5``, ``real1``..``real5``)."""
    return population_of(products, sample_counts(reviews))


def population_of(products: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` as from ``sample_counts``."""
    bd = F.col("bd")
    official = products.select(
        F.col("asin").alias("parent_asin"), "real_total_ratings", breakdown_map("rating_breakdown").alias("bd")
    )
    total = F.coalesce(F.nullif("real_total_ratings", F.lit(0)), F.col("n")).cast("double")
    spread = map_total(bd)

    def real(star: int) -> Column:
        share = F.when(spread > 0, star_value(bd, star) / spread * F.col("real_total")).otherwise(0.0)
        return F.when(bd.isNull(), F.col("real_total") / 5.0).otherwise(share).alias(f"real{star}")

    return (
        counts.join(official, "parent_asin", "left")
        .withColumn("real_total", total)
        .select("parent_asin", "real_total", *[f"n{s}" for s in STARS], *[real(s) for s in STARS])
    )


def _star_counts(tags: DataFrame, reviews: DataFrame, mapping: DataFrame, match: str) -> DataFrame:
    """Per (family, aspect): positive ``p1``..``p5`` and all ``c1``..``c5`` mentions by star."""
    starred = aspects.stars(tags, reviews)
    columns = [
        F.count_if((F.col("star") == s) & F.expr(aspects.IS_POSITIVE)).alias(f"p{s}") for s in STARS
    ] + [F.count_if(F.col("star") == s).alias(f"c{s}") for s in STARS]
    raw = starred.groupBy("parent_asin", F.col("aspect").alias("raw_aspect")).agg(*columns)
    return resolved_stars(raw, mapping, match)


def resolved_stars(raw: DataFrame, mapping: DataFrame, match: str) -> DataFrame:
    names = [f"{x}{s}" for x in "pc" for s in STARS]
    return (
        aspects.resolve_aspects(raw, mapping, match)
        .groupBy("parent_asin", "aspect")
        .agg(*[F.sum(c).alias(c) for c in names])
    )


def estimated_impact(
    products: DataFrame, reviews: DataFrame, tags: DataFrame, mapping: DataFrame, k: int | None = 20
) -> DataFrame:
    """Customers behind every aspect, extrapolated from the sample to the real population.

    A mention at a star stands for (real reviews / sampled reviews) customers at that star.
    Neutral mentions add to the negative side. Values are truncated toward zero.
    """
    return impact_of(_star_counts(tags, reviews, mapping, "exact"), population(products, reviews), k)


def impact_of(counts: DataFrame, people: DataFrame, k: int | None = 20) -> DataFrame:
    """``counts``: p1..p5 and c1..c5 of each family and aspect; ``people`` as from ``population``."""
    joined = counts.join(people, "parent_asin")

    def estimate(count: Column, star: int) -> Column:
        rate = count / F.col(f"n{star}")
        return F.when(F.col(f"n{star}") > 0, rate * F.col(f"real{star}")).otherwise(0.0)

    seen = sum((F.when(F.col(f"n{s}") > 0, F.col(f"c{s}")).otherwise(0) for s in STARS), F.lit(0))
    pos = sum((estimate(F.col(f"p{s}"), s) for s in STARS), F.lit(0.0))
    neg = sum((estimate(F.col(f"c{s}") - F.col(f"p{s}"), s) for s in STARS), F.lit(0.0))

    def whole(c: Column) -> Column:
        return F.round(c, 6).cast("bigint")

    out = joined.filter(seen > 0).select(
        "parent_asin", "aspect",
        whole(pos).alias("est_positive"), whole(neg).alias("est_negative"),
        whole(pos - neg).alias("net_impact"), whole(pos + neg).alias("total_impact_vol"),
    )
    order = [F.desc("total_impact_vol"), F.desc("net_impact"), F.asc("aspect")]
    return out if k is None else top_k(spread(out, "parent_asin", "aspect"), "parent_asin", order, k)


def weighted_scores(
    products: DataFrame, reviews: DataFrame, tags: DataFrame, mapping: DataFrame, k: int = 15
) -> DataFrame:
    """Positive rate per star weighted by the official star shares; lowest first.
    Products without a usable histogram have no rows."""
    bd = F.col("bd")
    shares = (
        products.select(F.col("asin").alias("parent_asin"), breakdown_map("rating_breakdown").alias("bd"))
        .withColumn("total", map_total(bd))
        .filter(F.col("total") > 0)
        .select("parent_asin", *[(star_value(bd, s) / F.col("total")).alias(f"w{s}") for s in STARS])
    )
    scored = _star_counts(tags, reviews, mapping, "norm").join(shares, "parent_asin")
    score = sum(
        (
            F.when(F.col(f"c{s}") > 0, F.col(f"p{s}") / F.col(f"c{s}") * F.col(f"w{s}")).otherwise(0.0)
            for s in STARS
        ),
        F.lit(0.0),
    )
    out = scored.select("parent_asin", "aspect", F.round(score, 8).alias("score"))
    top = top_k(spread(out, "parent_asin", "aspect"), "parent_asin", [F.asc("score"), F.asc("aspect")], k)
    return top.withColumn("score_pct", F.round(F.col("score") * 100, 6))


def rating_trend(reviews: DataFrame) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "review_date"))
    return reviews.groupBy("parent_asin", month.alias("month")).agg(F.avg("rating_score").alias("avg_score"))


def star_counts(reviews: DataFrame) -> DataFrame:
    star = F.round("rating_score").cast("int")
    return reviews.groupBy("parent_asin", star.alias("star")).agg(F.count("*").alias("cnt"))


def official_stars(products: DataFrame) -> DataFrame:
    """Official histogram in long form."""
    bd = F.col("bd")
    stars = F.explode(F.array(*[F.struct(F.lit(s).alias("star"), star_value(bd, s).alias("value")) for s in STARS]))
    return (
        products.select("asin", breakdown_map("rating_breakdown").alias("bd"))
        .filter(bd.isNotNull())
        .select("asin", stars.alias("s"))
        .select("asin", "s.star", "s.value")
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("parent_asin").agg(
        F.count("*").alias("review_count"), F.round(F.avg("rating_score"), 2).alias("avg_rating")
    )


def review_probe(reviews: DataFrame) -> DataFrame:
    """How many reviews a family already has, and the newest date."""
    return reviews.groupBy("parent_asin").agg(
        F.count("*").alias("reviews"), F.max("review_date").alias("last_date")
    )


def product_stats(
    products: DataFrame, reviews: DataFrame, tags: DataFrame, mapping: DataFrame, scope: DataFrame | None = None
) -> DataFrame:
    """The metrics document of every family: KPIs and bounded arrays, one row per family.

    ``scope`` (column ``asin``) restricts the run; it is applied to every input before any
    aggregation, so a stale-only run reads all but computes little.

    What the aggregates need of scope, reviews and tags is made once, written to the shared folder and read by each of them.
    """
    if scope is not None:
        wanted = stored(scope.select(F.col("asin").alias("parent_asin")).distinct(), "wanted")
        heads = wanted.withColumnRenamed("parent_asin", "asin")
        products = products.join(heads, "asin", "left_semi")
        reviews = reviews.join(wanted, "parent_asin", "left_semi")
        tags = tags.join(wanted, "parent_asin", "left_semi")

    reviews = stored(reviews.select("review_id", "parent_asin", "child_asin", "rating_score", "review_date"), "rated")
    tags = stored(tags.select("review_id", "parent_asin", "aspect", "sentiment"), "tagged")
    return document(
        product_kpis(products, reviews), aspects.aspect_mentions(tags, mapping, "exact", 2, 15),
        estimated_impact(products, reviews, tags, mapping), rating_trend(reviews),
    )


def document(kpi: DataFrame, mentions: DataFrame, impact: DataFrame, trend: DataFrame) -> DataFrame:
    """One row per family of ``kpi``; the others become arrays, bounded per family: top-k rows, or one row per calendar month."""

    def gathered(df: DataFrame, sort: list[str], name: str) -> DataFrame:
        values = [c for c in df.columns if c not in ("parent_asin", *sort)]
        sorted_rows = F.array_sort(F.collect_list(F.struct(*sort, *values)))
        return df.groupBy(F.col("parent_asin").alias("asin")).agg(sorted_rows.alias(name))

    raw = mentions.select("parent_asin", (-(F.col("positive") + F.col("negative"))).alias("key"), "aspect", "positive", "negative")
    weighted = impact.withColumn("key", -F.col("total_impact_vol")).withColumn("key2", -F.col("net_impact"))
    return (
        kpi.select("asin", F.struct(*[c for c in kpi.columns if c != "asin"]).alias("kpis"))
        .join(gathered(raw, ["key", "aspect"], "sentiment_raw"), "asin", "left")
        .join(gathered(weighted, ["key", "key2", "aspect"], "sentiment_weighted"), "asin", "left")
        .join(gathered(trend, ["month"], "rating_trend"), "asin", "left")
    )


def stats_json(stats: DataFrame) -> DataFrame:
    """Statistics as stored documents."""
    body = F.to_json(F.struct("kpis", "sentiment_raw", "sentiment_weighted", "rating_trend"))
    return stats.select("asin", body.alias("metrics_json"))
