"""Registered queries: data written by a sink and read back by a source."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewatlas.operators import clean, quality, stats, tags
from reviewatlas.operators.upsert import upsert
from reviewatlas.plans.cleaning import shown
from reviewatlas.plans.raws import raw_products, raw_reviews
from reviewatlas.plans.registry import query
from reviewatlas.plans.stats import _DOCUMENT, _flat_document, _mentions_sql
from reviewatlas.plans.tagging import responses, _FRESH
from reviewatlas.session import scratch_path
from reviewatlas.sources import readers, writers


@query("ndjson_reviews", "SELECT * FROM clean_reviews", ["clean_reviews"])
def _(t):
    raw, path = raw_reviews(t), scratch_path(t.spark, "reviews")
    writers.write_ndjson(raw, path)
    rows = clean.clean_reviews(readers.read_ndjson(t.spark, path, raw.schema))
    return shown(rows.filter(F.col("source_file").endswith(".json.lz4")))


_SHEET = ["asin", "parent_asin", "title", "brand", "real_average_rating", "real_total_ratings"]
# titles that a careless CSV reader breaks: quotes, commas, line breaks and backslashes
_AWKWARD = r"""CASE CAST(substr(asin, 2) AS BIGINT) % 5 WHEN 0 THEN '5" pan, "big"' WHEN 1 THEN title || chr(10) || 'second, line'
    WHEN 2 THEN 'back\slash\"' WHEN 3 THEN '"' ELSE title END"""


def _awkward(t):
    number = F.substring("asin", 2, 20).cast("bigint") % 5
    title = F.when(number == 0, '5" pan, "big"').when(number == 1, F.concat("title", F.lit("\nsecond, line"))).when(number == 2, 'back\\slash\\"').when(number == 3, '"')
    return t.products.withColumn("title", title.otherwise(F.col("title")))


@query("sheet_products", f"SELECT asin, parent_asin, {_AWKWARD} AS title, brand, real_average_rating, real_total_ratings FROM products", ["products"])
def _(t):
    rows, path = _awkward(t).select(*_SHEET), scratch_path(t.spark, "sheet")
    writers.write_csv(rows, path)
    return readers.read_sheet(t.spark, path, rows.schema)


@query("sheet_as_text", f"SELECT asin, {_AWKWARD} AS title, CAST(real_total_ratings AS VARCHAR) AS real_total_ratings FROM products", ["products"])
def _(t):
    path = scratch_path(t.spark, "sheet")
    writers.write_csv(_awkward(t).select("asin", "title", "real_total_ratings"), path)
    return readers.read_sheet_as_text(t.spark, path)


@query("feed_csv", "SELECT post_id, text, views FROM posts", ["posts"])
def _(t):
    path = scratch_path(t.spark, "feed")
    writers.write_csv(t.social_posts.select("post_id", "text", "views"), path)
    return readers.read_feed(t.spark, path, {"post_id": "string", "text": "string", "views": "bigint"})


def _dump(t):
    """Scrape lines: records, broken JSON and blanks."""
    raw = raw_products(t).select("seq", "asin", "title", "statusCode")
    line = F.when(F.col("seq") % 10 == 3, "{broken").when(F.col("seq") % 10 == 4, "  ").otherwise(F.to_json(F.struct(*raw.columns)))
    path = scratch_path(t.spark, "dump")
    writers.write_lines(raw.select(line.alias("value")), path)
    return readers.read_scrapes(t.spark, path, StructType.fromDDL("seq bigint, asin string, title string, statusCode int"))


@query("scrape_dump", "SELECT seq, asin, title, statusCode FROM raw_products WHERE seq % 10 NOT IN (3, 4) AND statusCode = 200 AND title <> ''", ["raw_products"])
def _(t):
    return _dump(t)[0]


@query("scrape_dump_rejects", "SELECT '{broken' AS line, count(*) AS lines FROM raw_products WHERE seq % 10 = 3", ["raw_products"])
def _(t):
    return _dump(t)[1].groupBy("line").agg(F.count("*").alias("lines"))


def _foldered(t, parts=()):
    """Products as files of equal names, one folder per category; a second file in each holds their ids alone."""
    path = scratch_path(t.spark, "files")
    rows = t.products.select("asin", "title", "category", F.col("category").alias("_folder"))
    rows.repartition("_folder").write.partitionBy("_folder").options(header=True, quote='"', escape='"').csv(path)
    rows.repartition("_folder").write.partitionBy("_folder").options(header=True, quote='"', escape='"', compression="gzip").mode("append").csv(path)
    return readers.read_matching(t.spark, path, "csv", "asin string, title string, category string", "*.csv*", parts)


# each id lies in a plain and in a compressed file of its category
@query("files_holding", """SELECT category, asin, count(*) AS files, CAST(count(*) AS BIGINT) AS rows FROM (SELECT category, asin FROM products UNION ALL SELECT category, asin FROM products)
    WHERE asin IN (SELECT a FROM pairs) GROUP BY 1, 2""", ["products", "pairs"])
def _(t):
    found = readers.files_holding(_foldered(t), t.pairs.select(F.col("a").alias("asin")), "asin")
    category = F.regexp_extract("file", "_folder=([^/]+)/", 1)
    return found.groupBy(category.alias("category"), "asin").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


# the name predicate leaves the plain files out
@query("files_holding_by_name", "SELECT category, asin FROM products WHERE asin IN (SELECT a FROM pairs)", ["products", "pairs"])
def _(t):
    found = readers.files_holding(_foldered(t, [".gz"]), t.pairs.select(F.col("a").alias("asin")), "asin")
    return found.select(F.regexp_extract("file", "_folder=([^/]+)/", 1).alias("category"), "asin")


# the files whose row counts are those of the two alphabetically first categories
@query("files_by_row_count", """SELECT * FROM (WITH c AS (SELECT category, count(*) AS rows FROM products GROUP BY 1)
    SELECT category, 2 AS files, rows FROM c WHERE rows IN (SELECT rows FROM c ORDER BY category LIMIT 2))""", ["products"])
def _(t):
    wanted = [r.rows for r in t.products.groupBy("category").agg(F.count("*").alias("rows")).orderBy("category").limit(2).collect()]
    found = readers.files_by_row_count(_foldered(t), wanted)
    return found.groupBy(F.regexp_extract("file", "_folder=([^/]+)/", 1).alias("category"), "rows").agg(F.count("*").cast("int").alias("files"))


@query("sql_with_parameters", "SELECT category, count(*) AS cnt FROM products WHERE real_total_ratings >= 500 GROUP BY 1", ["products"])
def _(t):
    text = "SELECT category, count(*) AS cnt FROM {products} WHERE real_total_ratings >= :low GROUP BY category"
    return readers.query(t.spark, text, {"low": 500}, products=t.products)


@query("response_lines", f"SELECT * FROM (WITH {_FRESH} SELECT review_id, aspect FROM f UNION ALL SELECT 'X' || review_id, 'ghost' FROM f)", ["reviews"])
def _(t):
    path = scratch_path(t.spark, "responses")
    writers.write_lines(responses(t), path)
    return tags.tag_items(readers.read_responses(t.spark, path)).select(F.col("id").alias("review_id"), F.col("a").alias("aspect"))


@query("request_lines", """SELECT * FROM (WITH w AS (SELECT review_id, text FROM reviews_text WHERE mining_status = 'PENDING' AND length(trim(text)) > 10),
    b AS (SELECT *, CAST('0x' || substr(md5(review_id), 1, 8) AS BIGINT) % 4096 AS bucket FROM w),
    p AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY review_id) - 1) // 200 AS batch FROM b)
    SELECT md5(string_agg('ID: ' || review_id || chr(10) || 'Text: ' || replace(replace(text, '"', ''''), chr(10), ' ') || chr(10) || '---' || chr(10), '' ORDER BY review_id)) AS body, 'm1' AS model
    FROM p GROUP BY bucket, batch)""", ["reviews_text"])
def _(t):
    path = scratch_path(t.spark, "requests")
    writers.write_lines(tags.request_lines(tags.review_requests(t.reviews_text), lambda body: body, "m1", 60000), path)
    lines = t.spark.read.text(path)
    return lines.select(
        F.md5(F.get_json_object("value", "$.request.contents[0].parts[0].text")).alias("body"),
        F.get_json_object("value", "$.request.model").alias("model"),
    )


@query("json_arrays", "SELECT asin, title, category FROM products", ["products"])
def _(t):
    """Files with one array of at most 500 records each."""
    path = scratch_path(t.spark, "arrays")
    block = F.floor(F.substring("asin", 2, 9).cast("bigint") / 500)
    rows = t.products.groupBy(block.alias("block")).agg(F.to_json(F.collect_list(F.struct("asin", "title", "category"))).alias("value"))
    rows.write.partitionBy("block").text(path)
    return readers.read_json_arrays(t.spark, f"{path}/*", "asin string, title string, category string")


@query("attached_snapshot", "SELECT category, count(*) AS products FROM products p JOIN product_parents pp USING (parent_asin, category) GROUP BY 1", ["products", "product_parents"])
def _(t):
    base = scratch_path(t.spark, "snapshot")
    t.products.select("parent_asin", "category").write.parquet(f"{base}/products")
    t.product_parents.select("parent_asin", "category").write.parquet(f"{base}/parents")
    readers.attach(t.spark, base, ["products", "parents"], "old")
    return t.spark.sql("SELECT category, count(*) AS products FROM old_products JOIN old_parents USING (parent_asin, category) GROUP BY 1")


@query("query_one", "SELECT max(real_total_ratings) AS most, CAST(NULL AS VARCHAR) AS nothing FROM products WHERE category = 'PROMO'", ["products"])
def _(t):
    most = readers.query_one(t.spark, "SELECT max(real_total_ratings) FROM {p} WHERE category = :c", {"c": "PROMO"}, p=t.products)
    nothing = readers.query_one(t.spark, "SELECT title FROM {p} WHERE asin = :a", {"a": "none"}, p=t.products)
    return t.spark.range(1).select(F.lit(most).cast("bigint").alias("most"), F.lit(nothing).cast("string").alias("nothing"))


@query("append_by_name", "SELECT platform, post_id, views, CAST(NULL AS BIGINT) AS likes, 2 AS copies FROM posts", ["posts"])
def _(t):
    base = scratch_path(t.spark, "posts")
    replicas = [f"{base}/a", f"{base}/b"]
    writers.append_by_name(t.social_posts.select("views", "post_id", "platform"), "social_posts", replicas)
    both = t.spark.read.parquet(*replicas)
    return both.groupBy("platform", "post_id", "views", "likes").agg(F.count("*").cast("int").alias("copies"))


@query("published_snapshots", "SELECT asin, CASE WHEN category <> 'SMALL' THEN title END AS title, 2 AS version FROM products", ["products"])
def _(t):
    base = scratch_path(t.spark, "published")
    writers.publish(t.products.select("asin", "title"), base)
    version = writers.publish(t.products.select("asin", F.when(F.col("category") != "SMALL", F.col("title")).alias("title")), base)
    return writers.current(t.spark, base).withColumn("version", F.lit(version))


@query("snapshot_versions_diff", """SELECT asin, title AS old_value, CAST(NULL AS VARCHAR) AS new_value, 'lost' AS change FROM products WHERE category = 'SMALL'""", ["products"])
def _(t):
    base = scratch_path(t.spark, "published")
    writers.publish(t.products.select("asin", "title"), base)
    writers.publish(t.products.select("asin", F.when(F.col("category") != "SMALL", F.col("title")).alias("title")), base)
    return quality.snapshot_diff(writers.current(t.spark, base, 1), writers.current(t.spark, base), "asin", "title")


@query("event_log", "SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS cnt, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "log")
    writers.log_events(t.raw("events"), path)
    log = t.spark.read.schema("event_id bigint, value double, event_type string, date date").json(path)
    return log.groupBy("event_type", "date").agg(F.count("*").alias("cnt"), F.round(F.sum("value"), 4).alias("value"))


@query("partition_rewrite", """SELECT category, count(*) AS cnt, CAST(sum(CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM products GROUP BY 1""", ["products"])
def _(t):
    path = scratch_path(t.spark, "parts")
    rows = t.products.select("asin", F.lit("old").alias("state"), "category")
    writers.overwrite_partitions(rows, path, ["category"])
    writers.overwrite_partitions(rows.filter("category = 'PROMO'").withColumn("state", F.lit("new")), path, ["category"])
    back = t.spark.read.parquet(path)
    return back.groupBy("category").agg(F.count("*").alias("cnt"), F.count_if(F.col("state") == "new").alias("fresh"))


@query("saved_stats", f"""SELECT d.* FROM ({_DOCUMENT.format(mentions=_mentions_sql("tags_exact", 2, 15), where="")}) d WHERE asin IN (SELECT parent_asin FROM product_parents WHERE category = 'PROMO')
    UNION ALL BY NAME SELECT asin, 0 AS total_reviews, '' AS raw_text, '' AS weighted_text, '' AS trend_text FROM kpis WHERE asin NOT IN (SELECT parent_asin FROM product_parents WHERE category = 'PROMO')""",
       ["kpis", "tags_exact", "impact", "reviews", "product_parents"])
def _(t):
    numbers = stats.product_stats(t.products, t.reviews, t.review_tags, t.aspect_mapping)
    documents = stats.stats_json(numbers)
    promo = t.product_parents.filter("category = 'PROMO'").select(F.col("parent_asin").alias("asin"))
    old = documents.withColumn("metrics_json", F.lit('{"kpis": {"total_reviews": 0}}'))
    saved = upsert(old, documents.join(promo, "asin", "left_semi"), ["asin"], "overwrite")
    return _flat_document(saved.select("asin", F.from_json("metrics_json", numbers.drop("asin").schema).alias("d")).select("asin", "d.*"))


@query("tracking_sheet", """SELECT parent_asin AS "Parent Asin", CASE WHEN category = 'PROMO' THEN 'Scraped' ELSE 'Pending' END AS "Status",
    CASE WHEN category = 'PROMO' THEN '2024-01-31 10:00' END AS "Last Scraped At" FROM product_parents""", ["product_parents"])
def _(t):
    sheet = t.product_parents.select(
        F.concat(F.col("parent_asin"), F.lit(" ")).alias("Parent Asin"), F.lit("Pending").alias("Status"), F.lit(None).cast("string").alias("Last Scraped At")
    )
    done = t.product_parents.filter("category = 'PROMO'").select(F.col("parent_asin").alias("asin"))
    return writers.mark_scraped(sheet, done, "2024-01-31 10:00").withColumn("Parent Asin", F.trim("Parent Asin"))


@query("tracking_pending", "SELECT parent_asin AS \"Parent Asin\" FROM product_parents WHERE category <> 'PROMO' ORDER BY 1 LIMIT 10", ["product_parents"])
def _(t):
    sheet = t.product_parents.select(
        F.col("parent_asin").alias("Parent Asin"), F.when(F.col("category") == "PROMO", "Scraped").otherwise("Pending").alias("Status")
    )
    return writers.pending(sheet, 10)
