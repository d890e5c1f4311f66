"""Registered queries: merges into stored tables that touch their buckets only, and tables kept up to date from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import buckets
from reviewatlas.operators import upsert as up
from reviewatlas.plans.linking import base, delivery, moves
from reviewatlas.plans.registry import QUERIES, query
from reviewatlas.session import scratch_path


#: Buckets of the tables here.
N = 16


def _stored(t, rows, keys, name):
    path = scratch_path(t.spark, name)
    buckets.store(rows, path, keys, N)
    return path, rows.schema


def _merged(t, source, **rules):
    path, schema = _stored(t, base(t), ["asin"], "catalogue")
    buckets.merge(t.spark, path, schema, source, ["asin"], N, **rules)
    return buckets.read(t.spark, path, schema, ["asin"])


@query("bucket_overwrite", QUERIES["upsert_overwrite"].oracle)
def _(t):
    return _merged(t, delivery(t), policy="overwrite")


@query("bucket_fill", QUERIES["upsert_fill"].oracle)
def _(t):
    return _merged(t, delivery(t), policy="fill")


@query("bucket_mixed", QUERIES["upsert_mixed"].oracle)
def _(t):
    return _merged(t, delivery(t), policy={"title": "overwrite", "brand": "overwrite", "category": "fill", "image_url": "fill"})


@query("bucket_guarded", QUERIES["upsert_guarded"].oracle)
def _(t):
    return _merged(t, delivery(t), policy={"category": up.guarded([None, "SMALL", "LARGE"])})


@query("bucket_insert", QUERIES["insert_missing"].oracle)
def _(t):
    path, schema = _stored(t, base(t), ["asin"], "catalogue")
    buckets.insert(t.spark, path, schema, delivery(t), ["asin"], N)
    return buckets.read(t.spark, path, schema, ["asin"])


@query("bucket_replace_children", QUERIES["replace_children"].oracle)
def _(t):
    path, schema = _stored(t, t.review_tags, ["review_id"], "tags")
    fresh = t.review_tags.filter(F.col("tag_id").endswith("5#1")).select(
        F.concat("review_id", F.lit("#n")).alias("tag_id"), "review_id", "parent_asin", F.lit("New").alias("category"),
        F.lit("fresh").alias("aspect"), "sentiment", "created_at",
    )
    buckets.replace(t.spark, path, schema, fresh, "review_id", n=N)
    return buckets.read(t.spark, path, schema, ["review_id"])


@query("bucket_relink", QUERIES["relink_reviews"].oracle)
def _(t):
    path, schema = _stored(t, t.reviews.select("review_id", "parent_asin"), ["parent_asin"], "reviews")
    buckets.relink(t.spark, path, schema, moves(t).withColumnRenamed("old", "parent_asin"), "parent_asin", "new", N)
    return buckets.read(t.spark, path, schema, ["parent_asin"])


@query("bucket_deliveries", """
    SELECT * FROM (WITH d AS (
        SELECT asin, 1 AS n, title || ' first' AS title FROM products WHERE category = 'PROMO'
        UNION ALL SELECT asin, 2, title || ' second' FROM products WHERE brand = 'Brand#11'
        UNION ALL SELECT 'X' || asin, 2, upper(title) FROM products WHERE brand = 'Brand#11'),
      l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asin ORDER BY n DESC, title DESC) = 1)
    SELECT coalesce(p.asin, l.asin) AS asin, CASE WHEN l.asin IS NULL THEN p.title ELSE l.title END AS title
    FROM products p FULL JOIN l ON p.asin = l.asin)""", ["products"])
def _(t):
    rows = base(t).select("asin", "title")
    path, schema = _stored(t, rows, ["asin"], "catalogue")
    some = base(t).filter("brand = 'Brand#11'")
    first = base(t).filter("category = 'PROMO'").select("asin", F.concat("title", F.lit(" first")).alias("title"))
    second = some.select("asin", F.concat("title", F.lit(" second")).alias("title")).union(some.select(F.concat(F.lit("X"), "asin"), F.upper("title")))
    buckets.merge_all(t.spark, path, schema, [first, second], ["asin"], N)
    return buckets.read(t.spark, path, schema, ["asin"])
