"""Product profiles, evidence search, catalogue and request triage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions import columns as C
from reviewatlas.functions.frames import apart, prefix_lists, top_k, whole
from reviewatlas.operators import aspects
from reviewatlas.operators.linkage import parent_lookup
from reviewatlas.operators.quality import QUEUE_OPEN, keyword_totals
from reviewatlas.operators.upsert import set_status, update_where

# Keyword groups of the customer-context report.
AUDIENCE = {
    "End-User: Kids/Teens": ["daughter", "son", "kid", "child", "teen", "girl", "boy", "granddaughter", "grandson"],
    "End-User: Adults/Self": ["master bedroom", "myself", "husband", "wife", "we"],
    "End-User: Guest": ["guest room", "visitor", "airbnb", "spare room"],
    "End-User: College Student": ["dorm", "college", "campus", "student"],
}
OCCASIONS = {
    "Gift": ["gift", "birthday", "christmas", "present", "xmas"],
    "Renovation": ["remodel", "new house", "moving", "makeover"],
    "Replacement": ["replace", "old comforter", "worn out"],
}


def search_evidence(
    tags: DataFrame, reviews: DataFrame, mapping: DataFrame, asin: str | None = None, aspect: str | None = None,
    sentiment: str | None = None, keywords: str | None = None, k: int = 30,
) -> DataFrame:
    """Newest tagged quotes of every family (or one) under optional conditions.

    ``aspect`` meets the standard or the raw name; ``keywords`` is a comma list of which one
    must occur in the quote or in the review text.

    Keywords are looked for where the texts lie, and quotes are carried by their digest: no text is ordered or meets a review.
    """
    words = [w.strip() for w in keywords.split(",")] if keywords else []
    rows, quotes = apart(chosen(tags, asin, sentiment).withColumn("_quoted", C.any_keyword([F.col("quote")], words)), "quote")
    said = C.any_keyword([F.col("text")] if keywords else [], words)
    hit = F.col("_quoted") | F.col("_said") if keywords else None
    return whole(newest_quotes(rows, reviews.withColumn("_said", said), mapping, aspect, hit, k), quotes, "quote")


def chosen(tags: DataFrame, asin: str | None, sentiment: str | None) -> DataFrame:
    if asin is not None:
        tags = tags.filter(F.col("parent_asin") == asin)
    if sentiment:
        tags = tags.filter(F.col("sentiment") == sentiment)
    return tags


def newest_quotes(rows: DataFrame, reviews: DataFrame, mapping: DataFrame, aspect: str | None, hit: Column | None, k: int) -> DataFrame:
    """``search_evidence`` on tags with digests for quotes; ``hit`` is a condition on the tags joined to ``_said`` of their reviews."""
    named = aspects.resolve_aspects(rows.withColumnRenamed("aspect", "raw_aspect"), mapping, "norm")
    conditions: list[Column] = []
    if aspect:
        want = C.norm(F.lit(aspect))
        conditions.append(
            F.coalesce(C.norm("standard_aspect") == want, F.lit(False)) | (C.norm("raw_aspect") == want)
        )
    joined = named.join(reviews.select("review_id", "variation_text", "review_date", *[c for c in ["_said"] if hit is not None]), "review_id")
    if hit is not None:
        conditions.append(hit)
    found = joined.filter(reduce(lambda a, b: a & b, conditions)) if conditions else joined
    order = [F.desc("review_date"), F.asc("tag_id")]
    slim = found.select("parent_asin", "tag_id", "aspect", "sentiment", "quote", "variation_text", "review_date")
    return top_k(slim, "parent_asin", order, k)


def evidence_board(tags: DataFrame, mapping: DataFrame, k: int = 300) -> DataFrame:
    """Quotes of every family with their mapping status."""
    rows, quotes = apart(tags, "quote")
    named = aspects.resolve_aspects(rows.withColumnRenamed("aspect", "raw_aspect"), mapping, "norm")
    rows = named.select(
        "parent_asin", "tag_id", F.coalesce("std_category", "category").alias("category"),
        C.aspect_label("standard_aspect", "raw_aspect").alias("aspect_status"), "sentiment", "quote",
    )
    order = [F.desc_nulls_last("sentiment"), F.asc_nulls_last("category"), F.asc("tag_id")]
    return whole(top_k(rows, "parent_asin", order, k), quotes, "quote")


def customer_context(reviews: DataFrame) -> DataFrame:
    """Reviews that speak of an audience or an occasion, per family; empty groups are left out."""
    kinds = {**{g: "target_audience" for g in AUDIENCE}, **{g: "usage_occasion" for g in OCCASIONS}}
    counts = keyword_totals(reviews, {**AUDIENCE, **OCCASIONS}).filter("cnt > 0")
    return counts.withColumn("kind", F.when(F.col("grp").isin(*OCCASIONS), "usage_occasion").otherwise(kinds[next(iter(AUDIENCE))]))


def listing_brief(products: DataFrame, tags: DataFrame, mapping: DataFrame, k: int = 5) -> DataFrame:
    """Facts for a listing text: who the product is, pain points to solve, strengths to show."""
    def ranked(sentiment: str, name: str) -> DataFrame:
        top = aspects.top_aspects(tags, mapping, sentiment, "norm", k)
        listed = F.array_sort(F.collect_list(F.struct("rank", "aspect")))
        return top.groupBy(F.col("parent_asin").alias("asin")).agg(
            F.array_join(F.transform(listed, lambda e: e["aspect"]), ", ").alias(name)
        )

    return (
        products.filter("asin = parent_asin").select("asin", "title", "material", "main_niche", "target_audience")
        .join(ranked("Negative", "pain_points"), "asin", "left").join(ranked("Positive", "strengths"), "asin", "left")
        .withColumn("pain_points", F.coalesce("pain_points", F.lit("None")))
        .withColumn("strengths", F.coalesce("strengths", F.lit("None")))
    )


def product_dna(
    products: DataFrame, parents: DataFrame, kpis: DataFrame, impact: DataFrame, k: int = 5
) -> DataFrame:
    """Profile of every family: parent facts, specifications, official numbers, best and worst
    aspects (strengths are the first, weaknesses the last of the impact ranking)."""
    order = [F.desc("total_impact_vol"), F.desc("net_impact"), F.asc("aspect")]
    reverse = [F.asc("total_impact_vol"), F.asc("net_impact"), F.desc("aspect")]

    def listed(rows: DataFrame, by: Sequence[Column], name: str, last: bool) -> DataFrame:
        best = top_k(rows, "parent_asin", by, k, rank="_r")
        key = -F.col("_r") if last else F.col("_r")
        names = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), "aspect"))), lambda e: e["aspect"])
        return best.groupBy("parent_asin").agg(F.array_join(names, "|").alias(name))

    strengths = listed(impact.filter("net_impact > 0"), order, "strengths", False)
    weaknesses = listed(impact.filter("net_impact < 0"), reverse, "weaknesses", True)
    specs = products.select(
        F.col("asin").alias("parent_asin"), "material", "target_audience", "size_capacity", "product_line", "variation_count",
        F.col("real_average_rating").alias("_avg"), F.col("real_total_ratings").alias("_total"),
    )
    market = kpis.select(F.col("asin").alias("parent_asin"), "avg_rating", "total_reviews")
    return (
        parents.select("parent_asin", "category", "niche", "title", "brand", "image_url")
        .join(specs, "parent_asin", "left").join(market, "parent_asin", "left")
        .join(strengths, "parent_asin", "left").join(weaknesses, "parent_asin", "left")
        .withColumn("avg_rating", F.coalesce("avg_rating", "_avg"))
        .withColumn("total_reviews", F.coalesce("total_reviews", "_total"))
        .drop("_avg", "_total")
    )


def catalogue(parents: DataFrame, products: DataFrame) -> DataFrame:
    """One row per parent with its best rating; the variations are listed by ``variation_pool``."""
    rated = products.groupBy("parent_asin").agg(F.max("real_average_rating").alias("avg_rating"), F.count("asin").alias("variations"))
    return parents.select("parent_asin", "category", "niche", "brand", "title").join(rated, "parent_asin", "left").withColumn(
        "variations", F.coalesce("variations", F.lit(0))
    )


def variation_pool(parents: DataFrame, products: DataFrame) -> DataFrame:
    """(parent_asin, asin): the child ids of every family of the catalogue, in long form. A parent without products has one row without a child."""
    return parents.select("parent_asin").join(products.select("parent_asin", "asin"), "parent_asin", "left")


def variation_text(products: DataFrame, length: int = 8) -> DataFrame:
    """Child ids of a family as ordered, comma-joined text, one row per id prefix."""
    return prefix_lists(products.select("parent_asin", "asin"), "parent_asin", "asin", "variation_pool", length)


def catalogue_variations(parents: DataFrame, products: DataFrame) -> DataFrame:
    """The catalogue with one row per variation: parents, their best rating, and each child id."""
    return catalogue(parents, products).join(variation_pool(parents, products), "parent_asin")


def ordered_catalogue(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.asc_nulls_last(c) for c in ("category", "niche", "brand", "parent_asin")])


def filter_catalogue(
    rows: DataFrame, products: DataFrame, category: str = "All", niche: str = "All", term: str | None = None
) -> DataFrame:
    """Catalogue under the explorer's filters; the term may also name a variation."""
    if category != "All":
        rows = rows.filter(F.col("category") == category)
    if niche != "All":
        rows = rows.filter(F.coalesce(F.col("niche").contains(niche), F.lit(False)))
    if not term:
        return rows
    by_child = products.filter(C.any_keyword([F.col("asin")], [term])).select("parent_asin").distinct().withColumn("_hit", F.lit(True))
    here = C.any_keyword([F.col("parent_asin"), F.col("title"), F.col("brand")], [term])
    return rows.join(by_child, "parent_asin", "left").filter(here | F.coalesce("_hit", F.lit(False))).drop("_hit")


def niche_values(rows: DataFrame) -> DataFrame:
    """Single niches of comma-joined lists, without placeholders."""
    return (
        rows.select("niche").distinct().select(F.explode(F.split("niche", ",")).alias("_v"))
        .select(F.trim("_v").alias("niche"))
        .filter((F.col("niche") != "") & ~F.col("niche").isin(*C.PLACEHOLDER_NICHES))
        .distinct()
    )


def family_detail(products: DataFrame, parents: DataFrame) -> DataFrame:
    """All variations; a parent without any gets one row of its own with nulls."""
    cols = ["asin", "parent_asin", "title", "brand", "image_url", "category", "main_niche", "material", "size_capacity",
            "target_audience", "product_line", "variation_count", "real_average_rating", "real_total_ratings", "rating_breakdown"]
    bare = parents.join(products.select("parent_asin").distinct(), "parent_asin", "left_anti").select(
        F.col("parent_asin").alias("asin"), "parent_asin", "title", "brand", "image_url", "category", F.col("niche").alias("main_niche")
    )
    return products.select(*cols).unionByName(bare, allowMissingColumns=True)


def first_valid(products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First non-null value of each column over a family, by child id."""
    return products.groupBy("parent_asin").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("asin"))).alias(c) for c in columns]
    )


def products_with_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    seen = reviews.select(F.col("parent_asin").alias("asin")).distinct()
    return products.join(seen, "asin", "left_semi").select(
        F.col("asin").alias("parent_asin"), "brand", "title", F.col("real_average_rating").alias("avg_rating")
    )


def latest_reviews(reviews: DataFrame, max_rating: float | None = None, k: int = 50) -> DataFrame:
    """Newest reviews of every family, optionally only the low ones."""
    rows = reviews if max_rating is None else reviews.filter(F.col("rating_score") <= max_rating)
    return top_k(rows, "parent_asin", [F.desc("review_date"), F.asc("review_id")], k)


def user_requests(queue: DataFrame, k: int = 5) -> DataFrame:
    """Newest requests of every user."""
    rows = queue.select("requested_by", "request_id", "asin", "status", "created_at")
    return top_k(rows, "requested_by", [F.desc("created_at"), F.asc("request_id")], k)


# Notes on requests.
UNKNOWN_NOTE = "[Unknown ASIN] Not in Product DB. Admin verify Parent."
CHILD_NOTE, PARENT_NOTE = "[Auto-Map] Child ", " -> Parent "
FORCED_NOTE, FORCED_DATE_NOTE = " | [Force Update Requested] Previous Data: ", " reviews, Last: "


def triage_requests(requests: DataFrame, products: DataFrame, reviews: DataFrame, queue: DataFrame) -> DataFrame:
    """Decide every request (``request_id, asin, note, force``): map a child to its family, then
    accept it or name the reason against it (data exists, already queued)."""
    probe = reviews.groupBy(F.col("parent_asin").alias("final_asin")).agg(
        F.count("*").alias("reviews"), F.max("review_date").alias("last_date")
    )
    waiting = queue.filter(F.col("status").isin(*QUEUE_OPEN)).select(F.col("asin").alias("final_asin")).distinct().withColumn("_q", F.lit(True))
    # what is known of an id in one row: the requests are joined once, also where one id is hot
    facts = probe.join(waiting, "final_asin", "full")
    mapped = requests.join(parent_lookup(products), "asin", "left")
    known = F.col("parent_asin").isNotNull()
    found = mapped.withColumn("final_asin", F.coalesce("parent_asin", "asin"))
    moved = F.col("final_asin") != F.col("asin")
    joined = found.join(facts, "final_asin", "left")
    has_data = F.coalesce(F.col("reviews") > 0, F.lit(False))
    decision = (
        F.when(has_data & ~F.col("force"), "HAS_DATA").when(F.col("_q"), "ALREADY_QUEUED")
        .when(~known, "QUEUED_UNKNOWN").when(moved, "QUEUED_AS_PARENT").otherwise("QUEUED")
    )
    remark = F.when(~known, UNKNOWN_NOTE).when(
        moved, F.concat(F.lit(CHILD_NOTE), "asin", F.lit(PARENT_NOTE), "final_asin")
    ).otherwise("")
    update = F.when(
        has_data & F.col("force"),
        F.concat(F.lit(FORCED_NOTE), F.col("reviews").cast("string"),
                 F.lit(FORCED_DATE_NOTE), F.col("last_date").cast("string")),
    ).otherwise("")
    system = F.concat(remark, update)
    full = F.when(F.length("note") > 0, F.concat(system, F.lit(" | "), "note")).otherwise(system)
    return joined.select("request_id", "asin", "final_asin", decision.alias("decision"), full.alias("full_note"))


def accepted_requests(decisions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Queue rows of the accepted requests; repeats of one final id become one row."""
    who = requests.select("request_id", "requested_by")
    rows = decisions.filter(F.col("decision").startswith("QUEUED")).join(who, "request_id")
    once = top_k(rows, "final_asin", [F.asc("request_id")], 1)
    return once.select(
        "request_id", F.col("final_asin").alias("asin"), F.lit("PENDING_APPROVAL").alias("status"), "requested_by",
        F.col("full_note").alias("note"), now.alias("created_at"),
    )


def decide_requests(queue: DataFrame, ids: DataFrame, approve: bool) -> DataFrame:
    """Approve or reject waiting requests by id."""
    return set_status(queue, ids, "request_id", "READY_TO_SCRAPE" if approve else "REJECTED", "status")


def dispatch_requests(queue: DataFrame, asins: DataFrame) -> DataFrame:
    """Approved requests of the given products go into work; others keep their status."""
    sent = asins.select("asin").distinct().withColumn("_sent", F.lit(True))
    ready = F.col("_sent") & (F.col("status") == "READY_TO_SCRAPE")
    joined = queue.join(sent, "asin", "left")
    return update_where(joined, ready, status=F.lit("IN_PROGRESS")).select(*queue.columns)


def chat_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it directly."""
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query"))
    told = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai_response"))
    return asked.join(told, ["conv_id", "turn"]).select(
        F.concat_ws("_", "conv_id", "turn").alias("chat_id"), "user_query", "ai_response"
    )
