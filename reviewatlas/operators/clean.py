"""Raw scrape records to canonical rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from reviewatlas.functions import columns as C
from reviewatlas.functions.frames import flatten_structs, keep_one, lower_names
from reviewatlas.schemas import conform

# Raw field names.
REVIEW_FIELDS = {
    "review_id": "reviewid", "parent_asin": "asin", "child_asin": "variationid",
    "author_name": "username", "rating_raw": "rating", "title": "title", "text": "text",
    "date_raw": "date", "verified_raw": "verified", "vine_raw": "vine",
    "helpful_raw": "numberofhelpful",
}
PRODUCT_FIELDS = {
    "comforter": {
        "title": ["title"], "brand": ["brand"], "main_niche": ["niche", "main niche"],
        "real_total_ratings": ["countratings"], "real_average_rating": ["productrating"],
    },
    "detail": {
        "title": ["title"], "brand": ["manufacturer"], "real_total_ratings": ["countreview"],
        "real_average_rating": ["productrating"], "image_url": ["mainimage/imageurl"],
    },
    "plain": {"title": ["producttitle"], "brand": ["brand"], "real_total_ratings": ["real_total_ratings"]},
}
CATEGORY_WORDS = {"book": ["book", "drawing"], "tumbler": ["tumbler", "bottle"]}
DEFAULT_CATEGORY = "comforter"
ATTRIBUTES = {
    "material": ["Material", "Fabric Type", "Material Composition"],
    "design_type": ["Style", "Pattern", "Theme"],
    "target_audience": ["Target Audience", "Department"],
    "size_capacity": ["Size", "Capacity"],
    "num_pieces": ["Number of Pieces"],
    "pack": ["Included Components"],
    "brand": ["Brand", "Publisher", "Manufacturer"],
}
LAST_ATTRIBUTES = {
    "material": ["material"], "design_type": ["design", "style"],
    "target_audience": ["audience", "target"], "gender": ["gender"],
}
SCRAPE_STARS = ["one_star", "two_star", "three_star", "four_star", "five_star"]
STAR_COLUMNS = {"5": "five", "4": "four", "3": "three", "2": "two", "1": "one"}


def with_lineage(df: DataFrame, status: str = "PENDING", file: Column | None = None) -> DataFrame:
    """Source file and first status. Rows that come from files carry ``_metadata``."""
    if file is None:
        file = F.col("_metadata.file_name") if "_metadata" in df.columns else F.lit(None).cast("string")
    return df.withColumn("source_file", file).withColumn("mining_status", F.lit(status))


def clean_reviews(raw: DataFrame, file: Column | None = None) -> DataFrame:
    """Typed reviews; rows without an id or a readable date are dropped."""
    raw = lower_names(raw)
    have = set(raw.columns)
    text = F.lit(None).cast("string")

    def pick(name: str) -> Column:
        return F.col(name).cast("string") if name in have else text

    if "variationlist/0" in have:
        variation = F.col("`variationlist/0`").cast("string")
    elif "variationlist" in have and isinstance(raw.schema["variationlist"].dataType, ArrayType):
        variation = F.get("variationlist", F.lit(0)).cast("string")
    else:
        variation = text
    named = raw.select(
        *[pick(source).alias(name) for name, source in REVIEW_FIELDS.items()],
        variation.alias("variation_text"),
        *([F.col("_metadata")] if "_metadata" in have else []),
    )
    typed = with_lineage(named, file=file).select(
        "review_id", "parent_asin", "child_asin", "variation_text", "author_name",
        C.rating_number("rating_raw", 0.0).alias("rating_score"), "title", "text",
        C.review_date("date_raw").alias("review_date"),
        C.text_bool("verified_raw").alias("is_verified"), C.text_bool("vine_raw").alias("vine_program"),
        C.int_or("helpful_raw", 0).alias("helpful_count"), "source_file", "mining_status",
    )
    return typed.filter(F.col("review_id").isNotNull() & F.col("review_date").isNotNull())


def _file_of(df: DataFrame, file: Column | str | None) -> Column | None:
    """What tells a row's file: the given column, else the path that readers carry."""
    if file is not None:
        return F.col(file) if isinstance(file, str) else file
    return F.col("_metadata.file_path") if "_metadata" in df.columns else None


def _with_vote(df: DataFrame, file: Column | str | None, name: str, vote: Column) -> DataFrame:
    """``df`` with an aggregate of each file, counted in one pass and joined back. Without files it is one value."""
    where = _file_of(df, file)
    if where is None:
        return df.withColumn(name, df.agg(vote).scalar())
    placed = df.withColumn("_file", where)
    votes = placed.groupBy(F.col("_file").alias("_of")).agg(vote.alias(name))
    return placed.join(votes, F.col("_file").eqNullSafe(F.col("_of")), "left").drop("_file", "_of")


def with_category(df: DataFrame, hint: str | None = None, title: str = "title", file: Column | str | None = None, name: str = "category") -> DataFrame:
    """``df`` with one category per file, from words in the file's titles, so a row's category does not depend on what else is read."""
    if hint or title not in df.columns:
        return df.withColumn(name, F.lit(hint or DEFAULT_CATEGORY))
    seen = [F.bool_or(C.any_keyword([F.col(title)], words)) for words in CATEGORY_WORDS.values()]
    vote = F.lit(DEFAULT_CATEGORY)
    for category, hit in reversed(list(zip(CATEGORY_WORDS, seen, strict=True))):
        vote = F.when(hit, category).otherwise(vote)
    return _with_vote(df, file, name, vote)


def default_if_all_null(df: DataFrame, column: str, value: Column, file: Column | str | None = None) -> DataFrame:
    """Fill a column of a file only where the file holds no value of it in any row."""
    voted = _with_vote(df, file, "_filled", F.count(column))
    filled = F.when(F.col("_filled") == 0, value).otherwise(F.col(column))
    return voted.withColumn(column, filled).drop("_filled")


def map_product_headers(df: DataFrame, category: Column) -> DataFrame:
    """Canonical product columns, each from the first raw header of its layout that exists.
    The layout depends on the category, and on the headers for all but one of them."""
    have = set(df.columns)
    other = "detail" if {"productdetails", "productrating"} & have else "plain"

    def source(layout: str, name: str) -> Column:
        for header in PRODUCT_FIELDS[layout].get(name, []):
            if header in have:
                return F.col(f"`{header}`").cast("string")
        return F.lit(None).cast("string")

    def pick(name: str) -> Column:
        chosen = F.when(category == DEFAULT_CATEGORY, source(DEFAULT_CATEGORY, name))
        return chosen.otherwise(source(other, name)).alias(name)

    parent = next((c for c in ("parentasin", "parent_asin") if c in have), None)
    return df.select(
        F.col("asin"),
        (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_asin"),
        *[pick(n) for n in ("title", "brand", "main_niche", "real_total_ratings", "real_average_rating", "image_url")],
        *(["_category"] if "_category" in have else []),
    )


def clean_products(raw: DataFrame, hint: str | None = None, file: Column | str | None = None) -> DataFrame:
    """Typed product rows, one per id: the id in the url wins over the one in the body.

    The category is voted per file, so one call may read many files; ``file`` names the column that tells them apart where rows
    carry no ``_metadata``."""
    where = _file_of(raw, file)
    if where is not None:
        raw = raw.withColumn("_source", where).drop("_metadata")
    flat = with_category(lower_names(flatten_structs(raw)), hint, file=None if where is None else "_source", name="_category").drop("_source")
    if "url" in flat.columns:
        flat = flat.withColumn("asin", F.coalesce(C.url_id("url"), F.col("asin")))
    mapped = map_product_headers(flat, F.col("_category"))
    typed = mapped.withColumn("real_average_rating", C.rating_number("real_average_rating"))
    once = keep_one(typed, "asin", [F.col(c).asc_nulls_last() for c in typed.columns])
    branded = once.withColumn("brand", C.clean_brand("brand"))
    # the category is never read from a header: it is the vote of the row's file
    return conform(branded.withColumnRenamed("_category", "category"), "products").select(
        "asin", "parent_asin", "title", "brand", "image_url", "real_average_rating", "real_total_ratings",
        "rating_breakdown", "variation_count", "material", "main_niche", "category",
    )


def attributes_to_columns(details: Column, key_map: Mapping[str, Sequence[str]] = ATTRIBUTES, sep: str = " | ") -> list[Column]:
    """One column per target: values of all attributes whose name contains a key, in order of
    appearance and once per matching key. Works inside the row; nothing is shuffled."""
    named = F.filter(
        F.transform(details, lambda d: F.struct(
            F.lower(F.trim(F.regexp_replace(d["name"], " ‏ : ‎|‏|‎", ""))).alias("name"), F.trim(d["value"]).alias("value"),
        )),
        lambda d: (d["name"] != "") & (d["value"] != ""),
    )

    def column(target: str, keys: Sequence[str]) -> Column:
        wanted = F.array(*[F.lit(k.lower()) for k in keys])
        hits = F.flatten(F.transform(named, lambda d: F.transform(
            F.filter(wanted, lambda k: d["name"].contains(k)), lambda _: d["value"]
        )))
        return C.blank_to_null(F.array_join(hits, sep)).alias(target)

    return [column(target, keys) for target, keys in key_map.items()]


def last_attribute(details: Column, needles: Sequence[str], first: bool = False) -> Column:
    """Value of the last (or first) attribute whose name contains one of the words."""
    hits = F.filter(details, lambda d: C.any_keyword([d["name"]], list(needles)))
    return F.try_element_at(hits, F.lit(1 if first else -1))["value"]


def valid_scrapes(raw: DataFrame) -> DataFrame:
    """Found pages with a title."""
    return raw.filter((F.col("statusCode") == 200) & (F.col("title") != ""))


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Scraped detail records with family ids and attribute columns."""
    child, parent = C.resolve_family("url", "asin")
    return (
        valid_scrapes(raw)
        .select(
            child.alias("asin"), parent.alias("parent_asin"), "title",
            F.get("imageUrlList", F.lit(0)).alias("image_url"),
            C.rating_number("productRating").alias("real_average_rating"),
            F.col("countReview").try_cast("bigint").alias("real_total_ratings"),
            *attributes_to_columns(F.col("productDetails")),
        )
        .filter(F.col("asin").isNotNull())
    )


def valid_products(df: DataFrame, key: str = "asin") -> DataFrame:
    return df.filter(F.length(key) > 0)


def clean_details(raw: DataFrame, category: str, seq: str) -> DataFrame:
    """Detail-worker records: family, brand, attributes, category fills, image and niche.
    The arrival order ``seq`` is carried along as ``_seq``."""
    child, parent = C.resolve_family("url", "asin", "parentAsin")
    details = F.col("productDetails")
    scraped = F.coalesce(C.blank_to_null("brand"), C.clean_brand("manufacturer", "detail"))
    listed = last_attribute(F.filter(details, lambda d: d["value"] != ""), ["brand"], first=True)
    brand = F.coalesce(C.blank_to_null(C.clean_brand(scraped, "detail")), listed)
    named = F.coalesce(*[C.blank_to_null(c) for c in ("title", "productTitle") if c in raw.columns])
    rows = raw.select(
        child.alias("asin"), parent.alias("parent_asin"), named.alias("title"),
        F.trim(F.replace(brand, F.lit("‎"), F.lit(""))).alias("brand"),
        *[last_attribute(details, words).alias(name) for name, words in LAST_ATTRIBUTES.items()],
        C.first_image("mainImage", "imageUrlList", isinstance(raw.schema["mainImage"].dataType, StringType)).alias("image_url"),
        C.niche_from_path("breadCrumbs", "categoriesExtended").alias("main_niche"),
        F.col(seq).alias("_seq"),
    ).filter(F.col("parent_asin").isNotNull())
    return fill_by_category(rows, category)


def fill_by_category(df: DataFrame, category: str) -> DataFrame:
    """Attribute values that the category and the title words imply."""
    title = F.col("title")
    bare = C.blank_to_null("material").isNull()
    if category == "tumbler":
        steel = C.any_keyword([title], ["stainless", "steel", "insulated"])
        return df.withColumn("material", F.when(bare & steel, "Stainless Steel").otherwise(F.col("material")))
    if category == "book":
        kids = C.any_keyword([title], ["kids", "children", "toddler"])
        unaimed = C.blank_to_null("target_audience").isNull()
        return df.withColumn("material", F.when(bare, "Paper").otherwise(F.col("material"))).withColumn(
            "target_audience", F.when(unaimed & kids, "Kids").otherwise(F.col("target_audience"))
        )
    return df


def clean_backfill(raw: DataFrame) -> DataFrame:
    """Catalogue records where every row is its own family."""
    title = F.coalesce("title", F.lit(""))
    return raw.filter((F.col("statusCode") == 200) & (F.col("asin") != "")).select(
        "asin", F.col("asin").alias("parent_asin"), title.alias("title"),
        C.clean_brand(F.coalesce("manufacturer", F.lit("N/A")), "credit").alias("brand"),
        F.get("imageUrlList", F.lit(0)).alias("image_url"),
        F.when(C.any_keyword([title], ["draw", "book"]), "book").otherwise(DEFAULT_CATEGORY).alias("category"),
        F.when(C.any_keyword([title], ["how to draw"]), "How to Draw").alias("niche"),
        C.rating_token(F.coalesce("productRating", F.lit("0"))).alias("real_average_rating"),
        F.coalesce(F.col("countReview").try_cast("bigint"), F.lit(0)).alias("real_total_ratings"),
    )


def build_breakdown(raw: DataFrame, seq: str) -> DataFrame:
    """Star percentages to a histogram document, the last row (by ``seq``) of an id winning.
    Rows with a missing or unreadable value, or nothing but zeros, do not count."""
    have = set(raw.columns)

    def star(word: str) -> Column:
        name = f"reviewSummary/{word}Star/percentage"
        return F.col(f"`{name}`").try_cast("double") if name in have else F.lit(0.0)

    stars = {s: star(word) for s, word in STAR_COLUMNS.items()}
    total = sum(stars.values(), F.lit(0.0))
    document = F.to_json(F.struct(*[c.alias(s) for s, c in stars.items()]))
    return (
        raw.select(
            F.coalesce(C.blank_to_null("asin"), C.blank_to_null("parentAsin")).alias("asin"),
            F.when(total > 0, document).alias("rating_breakdown"), F.col(seq).alias("_seq"),
        )
        .filter(F.col("asin").isNotNull() & F.col("rating_breakdown").isNotNull())
        .groupBy("asin").agg(F.max_by("rating_breakdown", "_seq").alias("rating_breakdown"))
    )


def scrape_plan(products: DataFrame, pages: int = 10) -> DataFrame:
    """One scrape task per id and star filter."""
    return products.select(F.trim("asin").alias("asin")).filter("asin <> ''").distinct().select(
        "asin", F.lit("com").alias("domainCode"), F.lit("recent").alias("sortBy"),
        F.explode(F.array(*[F.lit(s) for s in SCRAPE_STARS])).alias("filterByStar"), F.lit(pages).alias("maxPages"),
    )


def find_parent_asin(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parent id named in a page's source; null when there is none."""
    found = F.regexp_extract(html, r'"parentAsin"\s*:\s*"(B[A-Z0-9]{9})"', 1)
    return pages.withColumn("parent", C.blank_to_null(found))
