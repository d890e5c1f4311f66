"""Families: linking variations to parents, ingest, enrichment and truth repair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions import columns as C
from reviewatlas.functions.frames import apart, keep_one, whole
from reviewatlas.operators import clean
from reviewatlas.operators.upsert import (
    guarded, insert_missing, relink, retain_truth, unseen_rows, update_where, upsert,
)

# What generated rows say, and the words that repair the catalogue.
RECOVERED_TITLE = "Recovered Product: "
RECOVERED_BRAND = "Unknown"
RECOVERED_STATUS = "UNCERTAIN"
GENERATED_PARENT = "AUTO_GENERATED_PARENT"
SHEET_TITLE = "Imported from Excel"
DRINKWARE_NICHES = ["Tumblers", "Tumblers & Water Glasses", "Thermoses"]
DRINKWARE_WORDS = ["tumbler", "water bottle"]
DRAWING_WORDS = ["draw"]
DRAWING_NICHE = "Drawing Books"
STEEL_WORDS = ["stainless", "steel"]
KIDS_WORDS = ["kids", "children"]


def niche_rollup(products: DataFrame) -> DataFrame:
    """Distinct niches of a family joined with ', '. Duplicates are removed before the list is
    gathered, so its length is bounded by the niche vocabulary."""
    niche = F.col("main_niche")
    return (
        products.filter(niche.isNotNull() & (niche != "unknown"))
        .select("parent_asin", "main_niche").distinct()
        .groupBy("parent_asin")
        .agg(F.array_join(F.array_sort(F.collect_list("main_niche")), ", ").alias("niche"))
    )


def parent_lookup(products: DataFrame) -> DataFrame:
    """(asin, parent_asin) for every id in use, as child or as parent; one equi-join key
    instead of an OR."""
    own = products.select("asin", "parent_asin", F.lit(0).alias("_p"))
    heads = products.select(F.col("parent_asin").alias("asin"), "parent_asin", F.lit(1).alias("_p"))
    best = F.min_by("parent_asin", F.struct("_p", "parent_asin"))
    return (
        own.unionByName(heads).filter(F.col("asin").isNotNull())
        .groupBy("asin").agg(best.alias("parent_asin"))
    )


def link_reviews(
    raw: DataFrame, reviews: DataFrame, products: DataFrame, parents: DataFrame, long_history: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(new reviews, new parent rows) of cleaned review rows.

    The family comes from the products where the child id is known. Ids already stored are
    skipped; of equal new ids one row is kept. Texts are carried by their digest.
    """
    if "text" not in raw.columns:
        return link_rows(raw, reviews, products, parents, long_history)
    rows, texts = carried(raw)
    fresh, placeholders = link_rows(rows, reviews, products, parents, long_history)
    return whole(fresh, texts, "text"), placeholders


def carried(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``apart`` for cleaned reviews, with the tie-breaker of equal ids that needs the texts."""
    texts = [c for c in ("title", "text") if c in raw.columns]
    return apart(raw.withColumn("_tie", F.xxhash64(*texts)), "text")


def link_rows(
    raw: DataFrame, reviews: DataFrame, products: DataFrame, parents: DataFrame, long_history: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``link_reviews`` on rows without texts or with ``carried`` ones."""
    known = products.select(F.col("asin").alias("_child"), F.col("parent_asin").alias("_parent"))
    # rows without a child id meet nothing; keys of their own keep them off one task
    child = F.coalesce("child_asin", F.concat(F.lit("\x00"), F.coalesce("review_id", F.lit(""))))
    linked = raw.withColumn("_key", child).join(known, F.col("_key") == F.col("_child"), "left").withColumn(
        "parent_asin", F.coalesce("_parent", "parent_asin")
    ).drop("_key", "_child", "_parent")
    # copies go first, inside the map tasks; the anti join reuses their partitioning. Long texts are compared by their hash
    texts = [c for c in ("title", "text") if c in linked.columns]
    order = [F.col(c).asc_nulls_last() for c in linked.columns if c not in ("review_id", "_tie", *texts)]
    order += [F.col("_tie").asc()] if "_tie" in linked.columns else [F.xxhash64(*texts).asc()] if texts else []
    fresh = unseen_rows(reviews, keep_one(linked, "review_id", order).drop("_tie"), ["review_id"], long_history)
    families = linked.filter(F.col("parent_asin").isNotNull()).select("parent_asin").distinct()
    missing = unseen_rows(parents, families, ["parent_asin"], long_history)
    placeholders = missing.select(
        "parent_asin", F.lit("unknown").alias("category"),
        F.concat(F.lit(RECOVERED_TITLE), "parent_asin").alias("title"),
        F.lit(RECOVERED_BRAND).alias("brand"), F.lit(RECOVERED_STATUS).alias("verification_status"),
    )
    return fresh, placeholders


def family_rows(rows: DataFrame) -> DataFrame:
    """One row per family of a product batch: the parent's own row first."""
    families = rows.withColumn("parent_asin", F.coalesce("parent_asin", "asin"))
    order = [F.desc(F.col("asin") == F.col("parent_asin")), F.asc_nulls_last("asin")]
    return keep_one(families, "parent_asin", order)


def _refresh_niches(parents: DataFrame, products: DataFrame, touched: DataFrame) -> DataFrame:
    """Recompute the niche roll-up of the touched families."""
    wanted = touched.select("parent_asin").distinct()
    rolled = wanted.join(niche_rollup(products), "parent_asin", "left").withColumnRenamed("niche", "_niche")
    joined = parents.join(rolled.withColumn("_hit", F.lit(True)), "parent_asin", "left")
    return update_where(joined, F.col("_hit"), niche=F.col("_niche")).select(*parents.columns)


def ingest_products(raw: DataFrame, products: DataFrame, parents: DataFrame, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, parents) after a batch of raw product records."""
    rows = clean.clean_products(raw, hint)
    heads = family_rows(rows).select(
        "parent_asin", F.coalesce("category", F.lit("generic")).alias("category"), "title", "brand", "image_url"
    )
    new_parents = upsert(parents, heads, ["parent_asin"], {
        "category": "fill", "title": "overwrite", "brand": "overwrite", "image_url": "fill",
    })
    items = rows.withColumn("parent_asin", F.coalesce("parent_asin", "asin")).select(
        "asin", "parent_asin", "title", "brand", "image_url", "real_average_rating", "real_total_ratings", "main_niche", "category"
    )
    new_products = upsert(products, items, ["asin"], {"title": "fill", "brand": "fill", "main_niche": "fill"})
    return new_products, _refresh_niches(new_parents, new_products, heads)


def collapse_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key holding the last non-null value of every column, which is what
    applying the rows one after another with fill rules leaves behind."""
    values = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in values]
    )


def flag_multi_niche(parents: DataFrame, products: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Families with more than one niche are labelled; only the touched ones when given."""
    spread = products.groupBy("parent_asin").agg(F.count_distinct("main_niche").alias("_n")).filter("_n > 1").drop("_n")
    if touched is not None:
        spread = spread.join(touched.select("parent_asin").distinct(), "parent_asin", "left_semi")
    joined = parents.join(spread.withColumn("_multi", F.lit(True)), "parent_asin", "left")
    return update_where(joined, F.col("_multi"), niche=F.lit("Multi-Niche")).select(*parents.columns)


def enrich_details(raw: DataFrame, products: DataFrame, parents: DataFrame, category: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(products, parents) after a batch of detail records in ``seq`` order."""
    rows = clean.clean_details(raw, category, seq)
    heads = collapse_last(
        rows.select("parent_asin", F.lit(category).alias("category"), F.col("main_niche").alias("niche"), "title", "brand", "image_url", "_seq"),
        ["parent_asin"], "_seq",
    )
    new_parents = upsert(parents, heads, ["parent_asin"], {
        "category": guarded([None, "Unknown", "comforter"]), "niche": "fill", "title": "fill", "brand": "fill", "image_url": "fill",
    })
    values = ["title", "brand", "image_url", "material", "main_niche", "design_type", "target_audience", "gender"]
    values = [v for v in values if v in products.columns]
    items = collapse_last(
        rows.filter(F.col("asin").isNotNull()).select("asin", "parent_asin", *values, "_seq"), ["asin"], "_seq"
    )
    new_products = upsert(products, items, ["asin"], {v: "fill" for v in values})
    return new_products, flag_multi_niche(new_parents, new_products, rows.select("parent_asin"))


def apply_backfill(rows: DataFrame, products: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, parents) after a catalogue backfill: ratings are overwritten, texts filled."""
    heads = rows.select("parent_asin", "category", "niche", "title", "brand", "image_url")
    fill = {c: "fill" for c in ("category", "niche", "title", "brand", "image_url")}
    items = rows.select("asin", "parent_asin", "title", "brand", "image_url", "real_average_rating", "real_total_ratings", "category")
    rules = {"real_average_rating": "overwrite", "real_total_ratings": "overwrite", "title": "fill", "brand": "fill", "image_url": "fill"}
    return upsert(products, items, ["asin"], rules), upsert(parents, heads, ["parent_asin"], fill)


def enrich_children(raw: DataFrame, products: DataFrame, parents: DataFrame, priority: Column | None = None) -> DataFrame:
    """Products after adding the variations found in raw review rows of validated families.
    Known variations are only relinked. ``priority`` orders the sources (smallest first)."""
    rows = raw.select(
        F.col("variationId").alias("asin"), F.col("asin").alias("parent_asin"),
        F.col("productTitle").alias("title"), F.col("image").alias("image_url"), F.col("spec").alias("_spec"),
        (priority if priority is not None else F.lit(0)).alias("_prio"),
    ).filter(F.col("asin").isNotNull())
    valid = rows.join(parents.select("parent_asin"), "parent_asin", "left_semi")
    once = keep_one(valid, "asin", [F.asc("_prio"), *[F.col(c).asc_nulls_last() for c in ("parent_asin", "title", "image_url", "_spec")]])
    specs = F.when(F.col("_spec").isNotNull(), F.concat(F.lit('{"variation_0": "'), "_spec", F.lit('"}')))
    items = once.select("asin", "parent_asin", "title", "image_url", specs.alias("specs_json"))
    items = items.select(*[c for c in items.columns if c in products.columns])
    return upsert(products, items, ["asin"], {"parent_asin": "overwrite"})


def ghost_parents(products: DataFrame) -> DataFrame:
    """A row for every parent id that has none, made from its first child."""
    ghosts = (
        products.filter(F.col("parent_asin").isNotNull()).select("parent_asin").distinct()
        .join(products.select(F.col("asin").alias("parent_asin")), "parent_asin", "left_anti")
    )
    first = keep_one(products.join(ghosts, "parent_asin", "left_semi"), "parent_asin", [F.asc("asin")])
    made = first.withColumn("asin", F.col("parent_asin"))
    return made.withColumn("status_asin", F.lit(GENERATED_PARENT))


def add_ghost_parents(products: DataFrame) -> DataFrame:
    return products.withColumn("status_asin", F.lit(None).cast("string")).unionByName(ghost_parents(products))


# --- truth repair -------------------------------------------------------------------------


def repair_catalogue(products: DataFrame, parents: DataFrame, tumblers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Category, brand, niche and attribute corrections over the whole catalogue."""
    title, category, niche = F.col("title"), F.col("category"), F.col("niche")
    drinkware = niche.isin(*DRINKWARE_NICHES) | C.any_keyword([title], DRINKWARE_WORDS)
    named = F.col("parent_asin").isin(*tumblers) if tumblers else F.lit(False)
    fixed = update_where(parents, (F.coalesce(drinkware, F.lit(False)) & (category != "tumbler")) | named, category=F.lit("tumbler"))
    fixed = fixed.withColumn("brand", C.clean_brand("brand", "prefix"))
    drawing = (category == "book") & ((niche == "unknown") | niche.isNull()) & C.any_keyword([title], DRAWING_WORDS)
    fixed = update_where(fixed, drawing, niche=F.lit(DRAWING_NICHE))

    families = fixed.select("parent_asin", F.col("category").alias("_cat"), F.col("niche").alias("_niche"), F.lit(True).alias("_hit"))
    joined = products.join(families, "parent_asin", "left")
    steel = F.col("material").isNull() & (F.col("_cat") == "tumbler") & C.any_keyword([title], STEEL_WORDS)
    joined = update_where(joined, steel, material=F.lit("Stainless Steel"))
    bare = F.col("material").isNull() | F.col("target_audience").isNull()
    kids = bare & (F.col("_cat") == "book") & C.any_keyword([title], KIDS_WORDS)
    joined = update_where(joined, kids, material=F.lit("Paper"), target_audience=F.lit("Kids"))
    joined = joined.withColumn("brand", C.clean_brand("brand", "prefix"))
    synced = update_where(joined, F.col("_hit"), main_niche=F.col("_niche"))
    return synced.select(*products.columns), fixed


def sync_missing_parents(products: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents completed from self-defined families, nulls named, mixed families flagged."""
    own = products.filter("asin = parent_asin").select("parent_asin").distinct()
    made = (
        products.join(own, "parent_asin", "left_semi").groupBy("parent_asin")
        .agg(
            F.lit("unclassified").alias("category"), F.max("brand").alias("brand"), F.max("title").alias("title"),
            F.coalesce(F.max("main_niche"), F.lit("unknown")).alias("niche"),
        )
    )
    full = insert_missing(parents, made, ["parent_asin"])
    full = full.withColumn("category", F.coalesce("category", F.lit("unclassified")))
    vague = F.col("niche").isNull() | F.col("niche").isin("None", "Non-defined")
    return flag_multi_niche(update_where(full, vague, niche=F.lit("unknown")), products)


def first_seen(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources where the earlier source wins a key."""
    tagged = [df.withColumn("_prio", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).filter(F.col(key).isNotNull())
    order = [F.asc("_prio"), *[F.col(c).asc_nulls_last() for c in rows.columns if c not in (key, "_prio")]]
    return keep_one(rows, key, order).drop("_prio")


def rebuild_parents(products: DataFrame, sources: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(products, parents) with the parents rebuilt from truth sources in priority order.

    A source has ``asin, parent_asin, category, brand, title, niche``. The parents are replaced
    as a whole; products are relinked by the last source that names them.
    """
    heads = [
        df.withColumn("parent_asin", F.coalesce("parent_asin", "asin"))
        .select("parent_asin", "category", "brand", "title", "niche")
        for df in sources
    ]
    parents = first_seen(heads, "parent_asin")
    links = [
        df.filter(F.col("asin").isNotNull()).select("asin", F.coalesce("parent_asin", "asin").alias("_to"))
        for df in sources
    ]
    mapping = first_seen(list(reversed(links)), "asin")
    return relink(products, mapping, "asin", "_to", "parent_asin"), parents


def apply_truth(
    products: DataFrame, parents: DataFrame, reviews: DataFrame, truth: DataFrame, category: str = "comforter"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, parents, reviews) forced onto one category's truth sheet."""
    rows = truth.filter(F.col("parent_asin").isNotNull())
    heads = keep_one(rows, "parent_asin", [F.asc("asin")]).select(
        "parent_asin", F.lit(category).alias("category"), "title", "brand", F.col("main_niche").alias("niche")
    )
    complete = insert_missing(parents, heads, ["parent_asin"])
    own = heads.select(F.col("parent_asin").alias("asin"), F.col("parent_asin").alias("_to"))
    links = rows.groupBy("asin").agg(F.max("parent_asin").alias("_to"))
    linked = relink(relink(products, own, "asin", "_to", "parent_asin"), links, "asin", "_to", "parent_asin")
    kept = retain_truth(complete, heads, "parent_asin", F.col("category") == category)
    moved = relink(reviews, links.withColumnRenamed("asin", "child_asin"), "child_asin", "_to", "parent_asin")
    return linked, kept, moved


def cleanup_orphans(products: DataFrame, parents: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, parents) after relinking by a sheet, adding its families and refining the
    unclassified ones."""
    once = keep_one(sheet, "asin", [F.asc_nulls_last("parent_asin")])
    linked = relink(products, once.select("asin", F.col("parent_asin").alias("_to")), "asin", "_to", "parent_asin")
    heads = keep_one(once.filter(F.col("parent_asin").isNotNull()), "parent_asin", [F.asc("asin")]).select(
        "parent_asin", "category", "brand", "niche"
    )
    vague = ["unclassified", "Unknown"]
    refined = upsert(
        parents, heads.withColumn("title", F.lit(SHEET_TITLE)), ["parent_asin"],
        {"category": "overwrite", "brand": "overwrite", "niche": "overwrite"},
        only_if=lambda old: old["category"].isNull() | old["category"].isin(*vague),
    )
    return linked, refined


def parent_centric(products: DataFrame) -> DataFrame:
    """One representative row per family, its own id first; the row takes the family's id."""
    rows = products.withColumn("parent_asin", F.coalesce("parent_asin", "asin"))
    order = [F.desc(F.col("asin") == F.col("parent_asin")), F.asc("asin")]
    return keep_one(rows, "parent_asin", order).withColumn("asin", F.col("parent_asin"))


def target_ids(df: DataFrame) -> DataFrame:
    """All ids a sheet names, as child or as parent."""
    return (
        df.select("asin").union(df.select("parent_asin")).filter(F.col("asin").isNotNull()).distinct()
    )
