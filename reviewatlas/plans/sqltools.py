"""The named tools as SQL table functions: ``SELECT * FROM get_product_swot('A000000012')``.

Each function is a semi join of a set-wise view with the family of the asked id, a row that Catalyst moves below the grouping where the
family is a key of it. Functions and views belong to the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions.columns import norm
from reviewatlas.operators import aspects, compare, evidence, stats
from reviewatlas.operators.linkage import parent_lookup
from reviewatlas.plans import tools
from reviewatlas.plans.fixtures import Tables
from reviewatlas.plans.named import CHILD, OTHER, PARENT
from reviewatlas.plans.registry import QUERIES, Query

_OF_FAMILY = "LEFT SEMI JOIN atlas_family f ON {column} = f.parent_asin AND f.asin = asked"


def _views(t: Tables) -> dict[str, tuple[DataFrame, str]]:
    """Set-wise answers of the tools that only pick one family, and the column that holds it."""
    tags, mapping = t.review_tags, t.aspect_mapping
    impact = stats.estimated_impact(t.products, t.reviews, tags, mapping)
    return {
        "get_product_dna": (evidence.product_dna(t.products, t.product_parents, stats.product_kpis(t.products, t.reviews), impact), "parent_asin"),
        "find_better_alternatives": (compare.better_alternatives(t.products, t.product_parents, tags, mapping), "for_asin"),
        "get_product_swot": (compare.swot(t.review_tags_quoted, mapping), "parent_asin"),
        "analyze_customer_context": (evidence.customer_context(t.reviews_text), "parent_asin"),
        "generate_listing_content": (evidence.listing_brief(t.products, tags, mapping), "asin"),
        "analyze_competitors": (compare.competitor_gaps(t.products, t.product_parents, tags, mapping), "for_asin"),
    }


def _function(spark, name: str, arguments: str, columns: list[tuple[str, str]], body: str) -> None:
    returns = ", ".join(f"{c} {kind}" for c, kind in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({returns}) RETURN {body}")


def register(t: Tables) -> list[str]:
    """Make the eight functions over the given tables; their names."""
    spark = t.spark
    known = parent_lookup(t.products)
    # families that only reviews name stand for themselves
    alone = t.reviews.select(F.col("parent_asin").alias("asin")).dropna().distinct().join(known, "asin", "left_anti")
    known.unionByName(alone.withColumn("parent_asin", F.col("asin"))).createOrReplaceTempView("atlas_family")
    for name, (rows, column) in _views(t).items():
        rows.createOrReplaceTempView(f"atlas_{name}")
        _function(spark, name, "asked STRING", rows.dtypes, f"SELECT {', '.join(rows.columns)} FROM atlas_{name} s {_OF_FAMILY.format(column=f's.{column}')}")

    named = aspects.resolve_aspects(t.review_tags_quoted.withColumnRenamed("aspect", "raw_aspect"), t.aspect_mapping, "norm")
    named = named.withColumns({"_std": norm("standard_aspect"), "_raw": norm("raw_aspect")})
    named.createOrReplaceTempView("atlas_tagged")
    texts = t.reviews_text.select("review_id", "variation_text", "review_date", "text")
    texts.createOrReplaceTempView("atlas_texts")
    shown = ["parent_asin", "tag_id", "aspect", "sentiment", "quote", "variation_text", "review_date"]
    kinds = dict(named.dtypes) | dict(texts.dtypes)
    # a text is searched before the join, which moves the answer only
    within = "coalesce(exists(split(keywords, ','), w -> coalesce(contains(lower({}), lower(trim(w))), false)), false)"
    _function(spark, "search_review_evidence", "asked STRING, of_aspect STRING DEFAULT NULL, of_sentiment STRING DEFAULT NULL, keywords STRING DEFAULT NULL", [(c, kinds[c]) for c in shown], f"""
        SELECT {', '.join(shown)} FROM (SELECT * FROM atlas_tagged t {_OF_FAMILY.format(column='t.parent_asin')}) s
          JOIN (SELECT review_id, variation_text, review_date, {within.format('text')} AS _said FROM atlas_texts) r ON s.review_id = r.review_id
        WHERE (of_aspect IS NULL OR coalesce(_std = lower(trim(of_aspect)), false) OR _raw = lower(trim(of_aspect)))
          AND (of_sentiment IS NULL OR sentiment = of_sentiment)
          AND (keywords IS NULL OR _said OR {within.format('quote')})
        ORDER BY review_date DESC, tag_id LIMIT 30""")

    sides = aspects.aspect_sentiment(t.review_tags, t.aspect_mapping, "norm", 2)
    sides.createOrReplaceTempView("atlas_sides")
    kinds = dict(sides.dtypes)
    columns = [("a", "string"), ("b", "string"), ("aspect", "string"), ("score_a", kinds["pos_ratio"]), ("score_b", kinds["pos_ratio"]), ("mentions_a", "bigint"), ("mentions_b", "bigint")]
    _function(spark, "compare_head_to_head", "asked_a STRING, asked_b STRING", columns, """
        SELECT x.parent_asin AS a, y.parent_asin AS b, x.aspect, x.pos_ratio, y.pos_ratio, x.mentions, y.mentions
        FROM atlas_family fa JOIN atlas_sides x ON x.parent_asin = fa.parent_asin JOIN atlas_sides y ON x.aspect = y.aspect
          JOIN atlas_family fb ON y.parent_asin = fb.parent_asin WHERE fa.asin = asked_a AND fb.asin = asked_b
        ORDER BY x.mentions + y.mentions DESC, x.aspect LIMIT 10""")
    return sorted(tools.TOOLS)


def _query(name: str, oracle: str, call: str | None = None) -> None:
    def build(t: Tables) -> DataFrame:
        register(t)
        return t.spark.sql(f"SELECT * FROM {call or f"{name}('{CHILD}')"}")

    QUERIES[f"sql_{name}"] = Query(build, oracle)


for _name in ("get_product_swot", "analyze_customer_context", "generate_listing_content", "find_better_alternatives", "analyze_competitors"):
    _query(_name, QUERIES[f"tool_{_name}"].oracle)
_query("compare_head_to_head", QUERIES["tool_compare_head_to_head"].oracle, f"compare_head_to_head('{CHILD}', '{OTHER}')")
_query("search_review_evidence", QUERIES["tool_search_review_evidence"].oracle, f"search_review_evidence('{CHILD}', of_sentiment => 'Negative', keywords => 'the')")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_rating", F.round("avg_rating", 6))


_DNA = f"SELECT * FROM ({QUERIES['product_dna'].oracle}) WHERE parent_asin = '{PARENT}'"
_query("get_product_dna", _DNA)
_plain = QUERIES["sql_get_product_dna"].build
QUERIES["sql_get_product_dna"] = Query(lambda t: _rounded(_plain(t)), _DNA)
QUERIES["tool_get_product_dna"] = Query(lambda t: _rounded(tools.call("get_product_dna", t, asin=CHILD)), _DNA)
