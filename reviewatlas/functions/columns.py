"""Row-level column functions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NUMBER = r"(\d+\.?\d*)"
URL_ID = r"/dp/([A-Z0-9]{10})"
SENTIMENT_CODES = {"Pos": "Positive", "Neg": "Negative", "Neu": "Neutral"}
ROLES = "Author|Producer|Creator|Contributor|Illustrator"
PLACEHOLDER_NICHES = ["Non-defined", "unknown", "null"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c != "", c)


def norm(c: Column | str) -> Column:
    """Comparison key of a free-text aspect."""
    return F.lower(F.trim(_col(c)))


def rating_number(c: Column | str, default: float | None = None) -> Column:
    """First number in a rating text."""
    value = F.regexp_extract(_col(c).cast("string"), NUMBER, 1).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def rating_token(c: Column | str) -> Column:
    """First whitespace token of a rating as a number, 0 when it is not one."""
    return F.coalesce(F.split(_col(c).cast("string"), " ")[0].try_cast("double"), F.lit(0.0))


def review_date(c: Column | str) -> Column:
    """Date at the end of ``... on March 5, 2025``; null when it cannot be read."""
    return F.try_to_date(F.trim(F.regexp_replace(_col(c), r"^.*on ", "")), "MMMM d, yyyy")


def text_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c).cast("string")) == "true", F.lit(False))


def int_or(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(_col(c), F.lit(default).cast("string")).try_cast("int")


def url_id(c: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(_col(c), URL_ID, 1))


def resolve_family(
    url: Column | str, body: Column | str, parent: Column | str | None = None
) -> tuple[Column, Column]:
    """(child, parent) ids of a scraped row.

    Without ``parent``: the url names the family and the body the variation.
    With it: requested id first, then the scraped parent, then the scraped id.
    """
    requested, body = url_id(url), blank_to_null(body)
    if parent is None:
        return F.coalesce(body, requested), F.coalesce(requested, body)
    return body, F.coalesce(requested, blank_to_null(parent), body)


def _drop_first(c: Column, pattern: str) -> Column:
    """Remove the first match only."""
    return F.regexp_replace(c, rf"(?s)^(.*?){pattern}", "$1")


def clean_brand(c: Column | str, mode: str = "catalogue") -> Column:
    """Brand text without shop decorations.

    ``catalogue``: each decoration is removed once, plus a leading "by" and one role suffix.
    ``detail``: all decorations and left-to-right marks are removed.
    ``credit``: text between "by " and the first parenthesis.
    ``prefix``: decorations are removed only where the text starts or ends with them.
    """
    c = _col(c)
    if mode == "catalogue":
        for text in ("Visit the ", " Store", "Brand: "):
            c = _drop_first(c, text)
        c = F.regexp_replace(c, r"(?i)^by\s+", "")
        return F.trim(_drop_first(c, rf"\s*\((?:{ROLES})\)"))
    if mode == "detail":
        return F.trim(F.regexp_replace(c, "Brand: |Visit the | Store|‎", ""))
    if mode == "credit":
        plain = F.trim(F.split(F.replace(c, F.lit("by "), F.lit("")), r"\(")[0])
        return F.when(c.contains("N/A"), "N/A").otherwise(plain)
    if mode == "prefix":
        c = F.when(c.startswith("Brand: "), F.replace(c, F.lit("Brand: "), F.lit(""))).otherwise(c)
        c = F.when(
            c.startswith("Visit the "), F.replace(c, F.lit("Visit the "), F.lit(""))
        ).otherwise(c)
        return F.when(c.endswith(" Store"), F.replace(c, F.lit(" Store"), F.lit(""))).otherwise(c)
    raise ValueError(f"unknown brand mode {mode!r}")


def primary_niche(c: Column | str) -> Column:
    return F.trim(F.split(_col(c), ",")[0])


def niche_from_path(crumbs: Column | str, categories: Column | str) -> Column:
    """Last breadcrumb, else the name of the last category, else Unknown."""
    crumbs, categories = _col(crumbs), _col(categories)
    last = F.trim(F.try_element_at(F.split(crumbs, ">"), F.lit(-1)))
    named = F.try_element_at(categories, F.lit(-1))["name"]
    return (
        F.when(F.length(crumbs) > 0, last)
        .when(F.size(categories) > 0, named)
        .otherwise(F.lit("Unknown"))
    )


def first_image(main: Column | str, urls: Column | str, plain: bool = False) -> Column:
    """The ``main`` image where there is one, a struct or with ``plain`` its address, else the first of the list."""
    main = _col(main)
    return F.when(main.isNotNull(), main if plain else main["imageUrl"]).otherwise(F.get(_col(urls), F.lit(0)))


def breakdown_map(c: Column | str) -> Column:
    """Star histogram text as map<string,double>. One bad value does not lose the others;
    null means there was nothing to parse."""
    c = _col(c)
    raw = F.when(~F.trim(c).isin("", "{}"), F.from_json(c, "map<string,string>"))
    return F.transform_values(raw, lambda _, v: F.coalesce(v.try_cast("double"), F.lit(0.0)))


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)


def star_value(m: Column, star: int) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(str(star))), F.lit(0.0))


def sentiment_from_code(c: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SENTIMENT_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(c)), F.lit("Neutral"))


def sentiment_from_rating(c: Column | str) -> Column:
    """A missing or zero score counts as 3."""
    score = F.coalesce(F.nullif(_col(c), F.lit(0.0)), F.lit(3.0))
    return F.when(score >= 4, "Positive").when(score <= 2, "Negative").otherwise("Neutral")


def quote(c: Column | str, n: int = 100) -> Column:
    return F.substring(F.coalesce(blank_to_null(c), F.lit("N/A")), 1, n)


def prompt_record(key: Column | str, text: Column | str) -> Column:
    # two searches for a byte; translate rebuilds the text character by character
    flat = F.replace(F.replace(_col(text), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("ID: "), _col(key), F.lit("\nText: "), flat, F.lit("\n---\n"))


def product_label(
    asin: Column | str, title: Column | str, rating: Column | str, total: Column | str
) -> Column:
    title = F.coalesce(_col(title), F.lit("None"))
    short = F.when(
        F.length(title) > 25, F.concat(F.substring(title, 1, 25), F.lit("..."))
    ).otherwise(title)
    return F.concat(
        F.lit("["), _col(asin), F.lit("] "), short, F.lit(" | ⭐"),
        F.when(_col(rating).isNotNull(), F.format_string("%.1f", _col(rating))), F.lit(" ("),
        F.format_number(_col(total), 0), F.lit(")"),
    )


def aspect_label(standard: Column | str, raw: Column | str) -> Column:
    standard = _col(standard)
    return F.when(standard.isNotNull(), F.concat(F.lit("✅ "), standard)).otherwise(
        F.concat(F.lit("⏳ "), _col(raw))
    )


def any_keyword(columns: list[Column], keywords: list[str]) -> Column:
    """Case-insensitive substring match of any keyword in any column; null counts as no."""
    hit = F.lit(False)
    for column in columns:
        lowered = F.lower(column)
        for word in keywords:
            hit = hit | F.coalesce(lowered.contains(word.lower()), F.lit(False))
    return hit
