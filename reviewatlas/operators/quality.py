"""Audits, duplicate handling, coverage and snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions.columns import norm
from reviewatlas.functions.frames import apart, text_key, top_k, whole
from reviewatlas.operators import aspects

QUEUE_OPEN = ["PENDING_APPROVAL", "READY_TO_SCRAPE", "IN_PROGRESS"]


def stale_products(reviews: DataFrame, stats: DataFrame, tags: DataFrame) -> DataFrame:
    """Families with mined reviews or tags newer than their statistics (``asin, last_updated``)."""
    done = (
        reviews.filter("mining_status = 'COMPLETED'")
        .groupBy("parent_asin")
        .agg(F.max("ingested_at").alias("newest_review"))
    )
    tagged = tags.groupBy("parent_asin").agg(F.max("created_at").alias("newest_tag"))
    last = F.col("last_updated")
    return (
        done.join(stats.select(F.col("asin").alias("parent_asin"), "last_updated"), "parent_asin", "left")
        .join(tagged, "parent_asin", "left")
        .filter(last.isNull() | (F.col("newest_review") >= last) | (F.col("newest_tag") >= last))
        .select("parent_asin")
    )


def review_coverage(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Official total next to the number of sampled reviews, per product."""
    counted = reviews.groupBy(F.col("parent_asin").alias("asin")).agg(F.count("*").alias("_n"))
    return products.join(counted, "asin", "left").select(
        "category", "asin", F.coalesce("_n", F.lit(0)).alias("reviews_count"), "real_total_ratings", "rating_breakdown"
    )


def coverage_by_category(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return review_coverage(products, reviews).groupBy("category").agg(
        F.count("asin").alias("cnt"),
        F.count("real_total_ratings").alias("has_meta"),
        F.round(F.avg("reviews_count")).cast("bigint").alias("avg_rev"),
        F.round(F.avg("real_total_ratings")).cast("bigint").alias("avg_meta"),
    )


def first_per_category(products: DataFrame, reviews: DataFrame, k: int = 3) -> DataFrame:
    return top_k(review_coverage(products, reviews), "category", [F.asc("asin")], k)


def audit_products(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(
        F.count("*").alias("total_asins"),
        F.count("rating_breakdown").alias("have_breakdown"),
        F.round(F.avg("real_total_ratings")).cast("bigint").alias("avg_ratings"),
    )


def parents_by_category(parents: DataFrame) -> DataFrame:
    return parents.groupBy("category").agg(F.count("*").alias("cnt"))


def suspicious_rounding(products: DataFrame) -> DataFrame:
    """Totals above 99 that are whole hundreds."""
    total = F.col("real_total_ratings")
    return products.filter((total > 99) & (total % 100 == 0)).select(
        "asin", "category", "real_total_ratings", "rating_breakdown"
    )


def low_volume_sample(products: DataFrame, k: int = 5) -> DataFrame:
    """A repeatable sample of products with few ratings and a histogram."""
    low = products.filter(F.col("real_total_ratings").between(1, 499) & F.col("rating_breakdown").isNotNull())
    return (
        low.orderBy(F.md5("asin"), "asin").limit(k)
        .select("asin", "category", "real_total_ratings", "rating_breakdown")
    )


def pipeline_status(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("mining_status").agg(F.count("*").alias("cnt"))


def unmapped_debt(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Number of distinct raw aspects still to be standardised."""
    return aspects.unmapped(tags, mapping, 2, 40, numeric=True).agg(F.count("*").alias("unmapped_count"))


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN with an explicit rule: null keys on either side never match and never count."""
    known = right.select(F.col(right_key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    return left.filter(F.col(left_key).isNotNull()).join(known, F.col(left_key) == F.col("_k"), "left_anti")


def integrity_counters(products: DataFrame, parents: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per check."""
    children = products.filter("asin <> parent_asin")
    checks = {
        "total_products": products,
        "total_parents": parents,
        "distinct_families": products.select("parent_asin").distinct(),
        "orphan_products": unmatched(products, parents, "parent_asin", "parent_asin"),
        "false_parents": parents.join(children.select(F.col("asin").alias("parent_asin")).distinct(), "parent_asin", "left_semi"),
        "parents_without_reviews": unmatched(parents, reviews, "parent_asin", "parent_asin"),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("cnt"))
        out = row if out is None else out.unionByName(row)
    return out


def missing_parents(products: DataFrame, parents: DataFrame) -> DataFrame:
    """Families that define themselves in the products but have no parent row."""
    own = products.filter("asin = parent_asin").select("parent_asin").distinct()
    return unmatched(own, parents, "parent_asin", "parent_asin")


def unscraped_parents(parents: DataFrame, reviews: DataFrame, k: int | None = None) -> DataFrame:
    out = unmatched(parents.select("parent_asin"), reviews, "parent_asin", "parent_asin")
    return out if k is None else out.orderBy("parent_asin").limit(k)


def missing_metadata(parents: DataFrame, k: int = 20) -> DataFrame:
    return parents.filter(F.col("brand").isNull()).select("parent_asin").orderBy("parent_asin").limit(k)


def queue_view(queue: DataFrame, status: str, k: int | None = None) -> DataFrame:
    rows = queue.filter(F.col("status") == status).orderBy(F.desc("created_at"), F.asc("request_id"))
    return rows if k is None else rows.limit(k)


def _ranked_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    known = mapping.filter(F.col("standard_aspect").isNotNull()).select(
        F.col("raw_aspect").alias("aspect"), F.lit(1).alias("_mapped")
    ).distinct()
    return tags.join(known, "aspect", "left").withColumn("_mapped", F.coalesce("_mapped", F.lit(0)))


TAG_GROUP = ["review_id", "quote", "sentiment"]


def dedup_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """One tag per (review, quote, sentiment): mapped aspects first, then the newest."""
    order = [F.desc("_mapped"), F.desc("created_at"), F.asc("tag_id")]
    rows, quotes = apart(tags, "quote")
    return whole(top_k(_ranked_tags(rows, mapping), TAG_GROUP, order, 1), quotes, "quote").select(*tags.columns)


def dedup_stats(tags: DataFrame) -> DataFrame:
    """How many tags the clean-up keeps and deletes: every group keeps one."""
    sizes = tags.withColumn("quote", text_key("quote")).groupBy(*TAG_GROUP).agg(F.count("*").alias("n"))
    totals = sizes.agg(F.count("*").alias("keep"), (F.sum("n") - F.count("*")).alias("drop"))
    return totals.select(
        F.explode(F.array(
            F.struct(F.lit("KEEP").alias("action"), F.col("keep").alias("cnt")),
            F.struct(F.lit("DELETE").alias("action"), F.col("drop").alias("cnt")),
        )).alias("r")
    ).select("r.*").filter("cnt > 0")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys common to two sources and held by one only, with the share of the common ones."""
    tagged = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    both, in_left = F.count_if((F.col("l") == 1) & (F.col("r") == 1)), F.count_if(F.col("l") == 1)
    return tagged.agg(
        both.alias("common"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"),
        F.round(F.coalesce(F.try_divide(both * 100.0, in_left), F.lit(0.0)), 1).alias("common_pct"),
    )


def overlap_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key with the side(s) it occurs on."""
    tagged = left.select(key, F.lit(1).alias("s")).unionByName(right.select(key, F.lit(2).alias("s")))
    sides = tagged.groupBy(key).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    side = F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == 1, "left").otherwise("right")
    return sides.select(key, side.alias("side"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``column`` was lost, changed or gained between two snapshots."""
    before = old.select(key, F.col(column).alias("old_value"))
    after = new.select(key, F.col(column).alias("new_value"), *keep)
    a, b = F.col("old_value"), F.col("new_value")
    change = (
        F.when(a.isNotNull() & b.isNull(), "lost").when(a.isNotNull() & (a != b), "changed")
        .when(a.isNull() & b.isNotNull(), "gained")
    )
    return after.join(before, key).withColumn("change", change).filter(F.col("change").isNotNull())


def category_summary(left: DataFrame, right: DataFrame, suffixes: tuple[str, str] = ("_local", "_prod")) -> DataFrame:
    """Per-category counts of two snapshots side by side."""
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy("category").agg(
            F.count("*").alias(f"total{suffix}"), F.count("rating_breakdown").alias(f"has_bd{suffix}")
        )

    return side(left, suffixes[0]).join(side(right, suffixes[1]), "category")


def newly_filled(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Rows filled on the left whose key is not filled on the right."""
    filled = right.filter(F.col(column).isNotNull())
    return unmatched(left.filter(F.col(column).isNotNull()), filled, key, key)


def keyword_totals(reviews: DataFrame, groups: dict[str, list[str]], text: Column | None = None) -> DataFrame:
    """Reviews per family and keyword group, in one pass over the texts; groups without a hit
    are absent. No phrase is joined: each group is a predicate of the scan."""
    lowered = reviews.select("parent_asin", F.lower(F.col("text") if text is None else text).alias("_low"))

    def hit(words: list[str]) -> Column:
        """Short words first, as they are met sooner; a word that holds another adds nothing."""
        short = sorted({w.lower() for w in words}, key=lambda w: (len(w), w))
        needed = [w for i, w in enumerate(short) if not any(o in w for o in short[:i])]
        found = F.lit(False)
        for word in needed:
            found = found | F.col("_low").contains(word)
        return found

    names = list(groups)
    sums = [F.count_if(hit(groups[n])).alias(f"g{i}") for i, n in enumerate(names)]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("grp"), F.col(f"g{i}").alias("cnt")) for i, n in enumerate(names)]))
    return lowered.groupBy("parent_asin").agg(*sums).select("parent_asin", long.alias("r")).select("parent_asin", "r.*")


def verify_phrases(reviews: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """For each family and phrase: how many reviews hold it, zero included."""
    counts = keyword_totals(reviews, {p: [p] for p in phrases})
    return counts.select("parent_asin", F.col("grp").alias("phrase"), "cnt", (F.col("cnt") > 0).alias("found"))


def mapped_rows(target: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """How many rows a mapping touches."""
    return target.join(mapping.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("cnt"))


def normalised_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(norm(column).alias(column)).distinct()
