"""Registered queries: streaming jobs run to the end of their input, results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import partials
from reviewatlas.operators.clean import clean_reviews
from reviewatlas.plans.cleaning import REVIEW_COLUMNS, shown
from reviewatlas.plans.linking import _LINKED
from reviewatlas.plans.raws import raw_reviews
from reviewatlas.plans.registry import QUERIES, query
from reviewatlas.plans.tagging import responses
from reviewatlas.plans.stats import _DOCUMENT, _flat_document, _mentions_sql
from reviewatlas.schemas import conform
from reviewatlas.session import scratch_path
from reviewatlas.sources import writers
from reviewatlas.streaming import jobs


def _stream(t, name: str):
    """A driver table as a stream of files."""
    return jobs.read_files(t.spark, t.sf_dir, "parquet", t.raw(name).schema, f"{name}.parquet")


def _done(query) -> None:
    query.awaitTermination()


@query("stream_spend", "SELECT user_id, CAST(\"timestamp\" AS DATE) AS day, round(sum(cost_usd), 6) AS spend, count(*) AS charges FROM charges WHERE cost_usd > 0 GROUP BY 1, 2", ["charges"])
def _(t):
    base = scratch_path(t.spark, "spend")
    charges = _stream(t, "events").select("user_id", (F.col("value") / 1000).alias("cost_usd"), F.col("ts").alias("timestamp"))
    _done(jobs.stream_spend(charges, f"{base}/out", f"{base}/check"))
    spend = jobs.latest(t.spark.read.parquet(f"{base}/out"), ["window_start", "window_end", "user_id"])
    return spend.select("user_id", F.to_date("window_start").alias("day"), F.round("spend", 6).alias("spend"), "charges")


@query("stream_event_counts", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1, 2")
def _(t):
    base = scratch_path(t.spark, "counts")
    _done(jobs.stream_event_counts(_stream(t, "events"), f"{base}/out", f"{base}/check"))
    counts = jobs.latest(t.spark.read.parquet(f"{base}/out"), ["window_start", "window_end", "event_type"])
    return counts.select("event_type", F.to_date("window_start").alias("day"), "events")


@query("stream_status", "SELECT o_custkey AS user_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def _(t):
    base = scratch_path(t.spark, "status")
    events = _stream(t, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq")
    )
    _done(jobs.stream_status(events, "user_id", f"{base}/out", f"{base}/check"))
    return jobs.current_status(t.spark, f"{base}/out", "user_id")


def _ingest(t, by_month=False):
    base = scratch_path(t.spark, "ingest")
    raw = raw_reviews(t).withColumn("asin", F.concat(F.lit("S"), F.substring("asin", 2, 9)))
    writers.write_ndjson(raw, f"{base}/raw")
    stream = jobs.read_files(t.spark, f"{base}/raw", "json", raw.schema, "*.json.lz4")
    known = t.products.withColumn("asin", F.expr("IF(category = 'LARGE', 'X', '') || asin"))
    _done(jobs.stream_ingest(stream, known, t.product_parents, f"{base}/reviews", f"{base}/parents", f"{base}/check", by_month=by_month))
    return base


_EMPTY = _LINKED.replace("helpful_count > 4", "false")


@query("stream_ingest", f"""SELECT * FROM (WITH {_EMPTY} SELECT * FROM l
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY {', '.join(c + ' NULLS LAST' for c in REVIEW_COLUMNS[1:])}) = 1)""", ["clean_reviews", "reviews", "products"])
def _(t):
    return shown(t.spark.read.parquet(f"{_ingest(t)}/reviews"))


@query("stream_ingest_by_month", QUERIES["stream_ingest"].oracle)
def _(t):
    return shown(t.spark.read.parquet(f"{_ingest(t, True)}/reviews"))


_INDEXED = _LINKED + """, f AS (SELECT *, CASE WHEN rating_score <= 2 THEN 1 WHEN rating_score <= 4 THEN 2 ELSE 3 END AS delivery FROM l)"""


@query("stream_ingest_indexed", f"""SELECT * EXCLUDE (delivery) FROM (WITH {_INDEXED} SELECT * FROM f WHERE review_id NOT IN (SELECT review_id FROM stored)
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY delivery, {', '.join(c + ' NULLS LAST' for c in REVIEW_COLUMNS[1:])}) = 1)""", ["clean_reviews", "reviews", "products"])
def _(t):
    """Three deliveries into a filled table; ids come again in other deliveries and under other months."""
    base = scratch_path(t.spark, "indexed")
    raw = raw_reviews(t).withColumn("asin", F.concat(F.lit("S"), F.substring("asin", 2, 9)))
    score = F.coalesce(F.regexp_extract("rating", r"(\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))
    known = t.products.withColumn("asin", F.expr("IF(category = 'LARGE', 'X', '') || asin"))
    stored = t.reviews.withColumn("review_id", F.expr("IF(helpful_count > 4, '', 'old') || review_id"))
    jobs.add_to_index(stored, f"{base}/index", -1, 16)
    for part in (score <= 2, (score > 2) & (score <= 4), score > 4):
        writers.write_ndjson(raw.filter(part), f"{base}/raw", mode="append")
        stream = jobs.read_files(t.spark, f"{base}/raw", "json", raw.schema, "*.json.lz4")
        paths = [f"{base}/{p}" for p in ("reviews", "parents", "check")]
        _done(jobs.stream_ingest(stream, known, t.product_parents, *paths, index=f"{base}/index", n=16))
    return shown(t.spark.read.parquet(f"{base}/reviews"))


@query("stream_metrics", _DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15), where="WHERE k.asin IN (SELECT parent_asin FROM reviews)"), ["kpis", "tags_exact", "impact", "reviews"])
def _(t):
    """Reviews and tags in several batches; the first reviews had other tags, which are replaced. Only changes are added up."""
    base = scratch_path(t.spark, "metrics")
    reviews, n = t.reviews, 16
    early = reviews.filter("helpful_count <= 3").select("review_id", F.lit(True).alias("_early"))
    # the tags of all batches are made once
    partials.starred(t.review_tags, reviews).join(early, "review_id", "left").write.parquet(f"{base}/tagged")
    tagged = t.spark.read.parquet(f"{base}/tagged")
    first = tagged.filter("_early")
    wrong = first.withColumns({"aspect": F.concat(F.lit("old "), "aspect"), "sentiment": F.when(F.col("sentiment") == "Positive", "Negative").otherwise("Positive")})
    columns = ["review_id", "tag_id", "parent_asin", "aspect", "sentiment", "star"]
    batches = [(reviews.filter("helpful_count <= 3"), wrong), (reviews.filter("helpful_count > 3"), tagged.filter("_early IS NULL")), (None, first)]
    paths = [f"{base}/{p}" for p in ("review_parts", "tag_parts")]
    for new, tags in batches:
        if new is not None:
            new.select("review_id", "parent_asin", "child_asin", "review_date", "rating_score").write.mode("append").parquet(f"{base}/reviews")
        # all tags of a review in one file, so in one batch
        tags.select(*columns).repartition(2, "review_id").write.mode("append").parquet(f"{base}/tags")
        of = "review_id string, parent_asin string, child_asin string, review_date date, rating_score double"
        _done(jobs.stream_review_parts(jobs.read_files(t.spark, f"{base}/reviews", "parquet", of, "*.parquet"), paths[0], f"{base}/check1", n))
        stream = jobs.read_files(t.spark, f"{base}/tags", "parquet", tagged.select(*columns).schema, "*.parquet", per_batch=1)
        _done(jobs.stream_tag_parts(stream, f"{base}/tag_log", paths[1], f"{base}/check2", n))
        _done(jobs.stream_documents(t.spark, *paths, t.products, t.aspect_mapping, f"{base}/documents", f"{base}/check3", n))
    return _flat_document(jobs.latest(t.spark.read.parquet(f"{base}/documents"), ["asin"]))


@query("metrics_from_partials", QUERIES["metrics_document"].oracle)
def _(t):
    parts = partials.review_parts(t.reviews), partials.tag_parts(partials.starred(t.review_tags, t.reviews))
    return _flat_document(partials.document(t.products, *parts, t.aspect_mapping))


@query("stream_ingest_parents", f"""SELECT * FROM (WITH {_EMPTY} SELECT DISTINCT parent_asin, 'unknown' AS category, 'Recovered Product: ' || parent_asin AS title FROM l
    WHERE parent_asin NOT IN (SELECT parent_asin FROM product_parents))""", ["clean_reviews", "reviews", "products", "product_parents"])
def _(t):
    return t.spark.read.parquet(f"{_ingest(t)}/parents").select("parent_asin", "category", "title")


@query("stream_stats", _DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15), where="WHERE k.asin IN (SELECT parent_asin FROM reviews WHERE mining_status = 'COMPLETED' AND rating_score = 1)"),
       ["kpis", "tags_exact", "impact", "reviews"])
def _(t):
    base = scratch_path(t.spark, "stats")
    changed = t.reviews.filter("mining_status = 'COMPLETED' AND rating_score = 1").select("review_id", "parent_asin")
    changed.write.parquet(f"{base}/changes")
    stream = jobs.read_files(t.spark, f"{base}/changes", "parquet", changed.schema, "*.parquet")
    _done(jobs.stream_stats(stream, t.products, t.reviews, t.review_tags, t.aspect_mapping, f"{base}/out", f"{base}/check"))
    return _flat_document(jobs.latest(t.spark.read.parquet(f"{base}/out"), ["asin"]))


def _tagged(t):
    """The responses as a stream, twice: the second delivery repeats the first."""
    base = scratch_path(t.spark, "tagged")
    conform(t.reviews, "reviews").write.parquet(f"{base}/reviews")
    conform(t.review_tags, "review_tags").write.parquet(f"{base}/old")
    for _ in range(2):
        writers.write_lines(responses(t), f"{base}/lines", mode="append")
        lines = jobs.read_files(t.spark, f"{base}/lines", "text", "value string")
        paths = [f"{base}/{p}" for p in ("reviews", "old", "log", "stats", "check")]
        _done(jobs.stream_tags(lines, t.products, t.aspect_mapping, *paths))
    return base


@query("stream_tags", QUERIES["ingest_tags"].oracle)
def _(t):
    base = _tagged(t)
    return jobs.current_tags(t.spark, f"{base}/old", f"{base}/log").select("review_id", "parent_asin", "category", "aspect", "sentiment")


@query("compacted_status", "SELECT o_custkey AS user_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def _(t):
    base = scratch_path(t.spark, "compacted")
    log = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("batch"))
    log.write.parquet(f"{base}/log")
    jobs.compact(t.spark, f"{base}/log", ["user_id"], f"{base}/few")
    return t.spark.read.parquet(f"{base}/few").drop("batch")


@query("stream_clean", "SELECT * FROM clean_reviews", ["clean_reviews"])
def _(t):
    """Cleaning is the same function on a stream as on a table."""
    base = scratch_path(t.spark, "clean")
    raw = raw_reviews(t)
    writers.write_ndjson(raw, f"{base}/raw")
    stream = clean_reviews(jobs.read_files(t.spark, f"{base}/raw", "json", raw.schema, "*.json.lz4")).select(*REVIEW_COLUMNS)
    sink = stream.writeStream.format("parquet").options(**jobs.PACKED).option("path", f"{base}/out").option("checkpointLocation", f"{base}/check")
    _done(sink.trigger(availableNow=True).start())
    return shown(t.spark.read.parquet(f"{base}/out"))
