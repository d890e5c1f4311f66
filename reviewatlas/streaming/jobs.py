"""Incremental jobs. Every job is restartable: a replayed micro-batch writes the same rows.

Results that change are appended with their batch number and read through ``latest``: no
table is rewritten per batch, and a replayed batch adds equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reviewatlas.functions.frames import keep_one, whole
from reviewatlas.operators import buckets, clean, linkage, partials, stats, tags
from reviewatlas.operators.upsert import latest_status
from reviewatlas.schemas import SCHEMAS, conform
from reviewatlas.sources.writers import overwrite_partitions

Batch = Callable[[DataFrame, int], None]


def table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that may not exist yet."""
    schema = SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row of every key of a log with a ``batch`` column."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    return keep_one(log, list(keys), [F.desc("batch"), *[F.desc_nulls_last(c) for c in values]]).drop("batch")


def _start(stream: DataFrame, batch: Batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(batch).trigger(availableNow=True).start()


def read_files(spark: SparkSession, path: str, fmt: str, schema: StructType | str, glob: str = "*", per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


#: Partition column of a reviews table kept by month.
MONTH = "review_month"


def month_of(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


#: Reviews are stored with their texts, which pack well. So many months are written side by side by a task, and what each of their files may hold in memory.
OPEN_MONTHS = 128
PACKED = {"compression": "zstd"}
SMALL_BUFFERS = PACKED | {"parquet.block.size": 2 << 20, "parquet.page.size": 1 << 18, "parquet.dictionary.page.size": 1 << 18}


def side_by_side(spark: SparkSession) -> None:
    """Let the tasks of a micro-batch write several partitions at once; rows with long texts then need not be sorted by partition, so they are
    not spilled. Further partitions than ``OPEN_MONTHS`` are sorted. ``spark`` is the session of a batch, a copy: the user's keeps its settings."""
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_MONTHS)


def history(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The stored reviews of the months that occur in ``batch``; other partitions are not read. A list of months is short, whatever the table's size."""
    schema = StructType([*SCHEMAS["reviews"].fields, StructField(MONTH, StringType())])
    months = [r[0] for r in batch.select(month_of("review_date")).distinct().collect()]
    return table(spark, path, schema).filter(F.col(MONTH).isin(months))


#: Partition column of tables that a repeated batch replaces its own part of.
BATCH = "batch"
_INGESTED = StructType([*SCHEMAS["reviews"].fields, StructField(MONTH, StringType()), StructField(BATCH, LongType())])
#: What an id index holds of a review: where it is stored, and what its tags need.
INDEX = f"review_id string, parent_asin string, star int, {MONTH} string"


def log_part(rows: DataFrame, path: str, keys: Sequence[str], number: int, n: int) -> None:
    """Write the part of a batch in a log by bucket and batch. The same batch again replaces it."""
    placed = rows.withColumns({buckets.BUCKET: buckets.bucket_of(keys, n), BATCH: F.lit(number).cast("bigint")})
    overwrite_partitions(placed.hint("rebalance", buckets.BUCKET), path, [buckets.BUCKET, BATCH])


def read_log(spark: SparkSession, path: str, ddl: str, only: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of such a log: those of the given buckets, and of batches before one."""
    rows = table(spark, path, f"{ddl}, {buckets.BUCKET} int, {BATCH} bigint")
    if only is not None:
        rows = rows.filter(F.col(buckets.BUCKET).isin(list(only)))
    return rows.filter(F.col(BATCH) < before) if before is not None else rows


def add_to_index(reviews: DataFrame, index: str, number: int, n: int = buckets.BUCKETS) -> None:
    rows = reviews.select("review_id", "parent_asin", partials.star().alias("star"), month_of("review_date").alias(MONTH))
    log_part(rows, index, ["review_id"], number, n)


def known_ids(spark: SparkSession, index: str, rows: DataFrame, n: int = buckets.BUCKETS, before: int | None = None) -> DataFrame:
    """The index entries of the buckets that ``rows`` touch, of earlier batches."""
    return read_log(spark, index, INDEX, buckets.touched(rows, ["review_id"], n), before)


def stream_ingest(
    raw: DataFrame, products: DataFrame, parents: DataFrame, reviews_path: str, parents_path: str, checkpoint: str,
    dedup_delay: str | None = None, by_month: bool = False, index: str | None = None, n: int = buckets.BUCKETS,
) -> StreamingQuery:
    """Raw review files to the reviews table: clean, link to the family, add unseen ids.

    Seen ids are excluded against the whole table, however old. ``dedup_delay`` drops repeats
    in the stream as well, within that delay of the file times, before the table is read.
    New families are appended as placeholders to ``parents_path``.

    With ``by_month`` the reviews table is partitioned by the month of the review, and a batch reads the ids of its own months
    only. It fits sources in which a review keeps its date; an id that returns under another month would be added again.

    With ``index``, the path of an id index (``indexed``), the reviews are partitioned by month and batch, and a batch reads the index for the
    buckets of its ids only: whatever month an id returns under, it is known. The reviews of a batch, then its part of
    the index are written as partitions of their own, so a batch that is repeated replaces what it wrote and ignores it as history.
    """
    if dedup_delay:
        seen = raw.withColumn("_seen", F.col("_metadata.file_modification_time"))
        key = next(c for c in raw.columns if c.lower() == clean.REVIEW_FIELDS["review_id"])
        raw = seen.withWatermark("_seen", dedup_delay).dropDuplicatesWithinWatermark([key])

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        added = table(spark, parents_path, "product_parents")
        cleaned = clean.clean_reviews(df)
        # which copies a stream lets through is decided once; files give the same rows again, so their texts are not kept
        kept = cleaned.persist(StorageLevel.MEMORY_AND_DISK) if dedup_delay else None
        rows, texts = linkage.carried(cleaned)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if index:
                held = known_ids(spark, index, rows, n, before=number)
            else:
                held = history(spark, reviews_path, rows) if by_month else table(spark, reviews_path, "reviews")
            known = parents.select("parent_asin").unionByName(added.select("parent_asin"))
            fresh, heads = linkage.link_rows(rows, held, products, known, long_history=True)
            conform(heads, "product_parents").write.mode("append").parquet(parents_path)
            new = conform(whole(fresh, texts, "text"), "reviews")
            if index or by_month:
                side_by_side(spark)
            if index:
                overwrite_partitions(new.withColumns({MONTH: month_of("review_date"), BATCH: F.lit(number).cast("bigint")}), reviews_path, [MONTH, BATCH], **SMALL_BUFFERS)
                months = [r[0] for r in rows.select(month_of("review_date")).distinct().collect()]
                written = table(spark, reviews_path, _INGESTED).filter(F.col(MONTH).isin(months) & (F.col(BATCH) == number))
                add_to_index(written, index, number, n)
            elif by_month:
                new.withColumn(MONTH, month_of("review_date")).write.mode("append").options(**SMALL_BUFFERS).partitionBy(MONTH).parquet(reviews_path)
            else:
                new.write.mode("append").options(**PACKED).parquet(reviews_path)
        finally:
            rows.unpersist()
            if kept is not None:
                kept.unpersist()

    return _start(raw, batch, checkpoint)


def stream_status(events: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Status events (key, status, seq) to a log with the newest row per key and batch.
    ``current_status`` resolves it; nothing is kept in a state store."""

    def batch(df: DataFrame, _: int) -> None:
        latest_status(df, key, "seq").write.mode("append").parquet(path)

    return _start(events.select(key, "status", "seq"), batch, checkpoint)


def current_status(spark: SparkSession, path: str, key: str) -> DataFrame:
    return latest_status(spark.read.parquet(path), key, "seq")


def stream_stats(
    changes: DataFrame, products: DataFrame, reviews: DataFrame | str, tagged: DataFrame | str, mapping: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """New tags or reviews (column ``parent_asin``): recompute only the families they touch. Tables given by path are read
    again in every batch."""

    def batch(df: DataFrame, number: int) -> None:
        touched = df.select(F.col("parent_asin").alias("asin")).distinct()
        now = [table(df.sparkSession, x, name) if isinstance(x, str) else x for x, name in ((reviews, "reviews"), (tagged, "review_tags"))]
        fresh = stats.product_stats(products, *now, mapping, touched)
        fresh.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(path)

    return _start(changes, batch, checkpoint)


def stream_review_parts(reviews: DataFrame, path: str, checkpoint: str, n: int = buckets.BUCKETS) -> StreamingQuery:
    """New reviews to signed partial sums, by family. A batch reads its own rows only."""

    def batch(df: DataFrame, number: int) -> None:
        log_part(partials.review_parts(df), path, ["parent_asin"], number, n)

    return _start(reviews, batch, checkpoint)


_TAGGED = "review_id string, tag_id string, parent_asin string, aspect string, sentiment string, star int"


def stream_tag_parts(tagged: DataFrame, tags_log: str, path: str, checkpoint: str, n: int = buckets.BUCKETS) -> StreamingQuery:
    """Tags of covered reviews (columns of ``_TAGGED``) to signed partial sums: a review's new tags count up, those it had count down.

    All tags of a review come in one batch; a row without an aspect only says that the review is covered. A batch reads the log of tags
    for the buckets of its reviews, earlier batches only, so it gives the same sums when it is repeated.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.select(*[c.split()[0] for c in _TAGGED.split(", ")]).dropDuplicates().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            done = rows.select("review_id").dropna().distinct()
            stored = read_log(spark, tags_log, _TAGGED, buckets.touched(done, ["review_id"], n), number).join(done, "review_id", "left_semi")
            newest = stored.groupBy("review_id").agg(F.max(BATCH).alias(BATCH))
            gone = stored.join(newest, ["review_id", BATCH], "left_semi")
            change = partials.tag_parts(rows.dropna(subset=["aspect"])).unionByName(partials.tag_parts(gone.dropna(subset=["aspect"]), -1))
            log_part(partials.added(change, partials.TAG_KEYS, partials.TAG_SUMS), path, ["parent_asin"], number, n)
            log_part(rows.dropna(subset=["review_id"]), tags_log, ["review_id"], number, n)
        finally:
            rows.unpersist()

    return _start(tagged, batch, checkpoint)


def documents(
    spark: SparkSession, review_parts: str, tag_parts: str, products: DataFrame, mapping: DataFrame, families: DataFrame | None = None, n: int = buckets.BUCKETS
) -> DataFrame:
    """Metrics documents from the partial sums, of the given families (column ``parent_asin``): reads the buckets of those only."""
    only = None if families is None else buckets.touched(families, ["parent_asin"], n)
    reviews = read_log(spark, review_parts, partials.REVIEW_SCHEMA, only)
    tagged = read_log(spark, tag_parts, partials.TAG_SCHEMA, only)
    if families is not None:
        wanted = families.select("parent_asin").dropna().distinct()
        reviews, tagged = reviews.join(wanted, "parent_asin", "left_semi"), tagged.join(wanted, "parent_asin", "left_semi")
        products = products.join(wanted.withColumnRenamed("parent_asin", "asin"), "asin", "left_semi")
    return partials.document(
        products, partials.added(reviews, partials.REVIEW_KEYS, partials.REVIEW_SUMS), partials.added(tagged, partials.TAG_KEYS, partials.TAG_SUMS), mapping
    )


def stream_documents(
    spark: SparkSession, review_parts: str, tag_parts: str, products: DataFrame, mapping: DataFrame, path: str, checkpoint: str, n: int = buckets.BUCKETS
) -> StreamingQuery:
    """New documents of the families whose partial sums changed, chained behind the two jobs above: their logs are its input."""
    logs = [
        spark.readStream.schema(f"{ddl}, {buckets.BUCKET} int, {BATCH} bigint").parquet(p).select("parent_asin")
        for p, ddl in ((review_parts, partials.REVIEW_SCHEMA), (tag_parts, partials.TAG_SCHEMA))
    ]

    def batch(df: DataFrame, number: int) -> None:
        fresh = documents(df.sparkSession, review_parts, tag_parts, products, mapping, df.distinct(), n)
        fresh.withColumn(BATCH, F.lit(number).cast("bigint")).write.mode("append").parquet(path)

    return _start(logs[0].union(logs[1]), batch, checkpoint)


def compact_parts(spark: SparkSession, path: str, ddl: str, keys: Sequence[str], sums: Sequence[str], to: str, n: int = buckets.BUCKETS) -> None:
    """Add up a log of partial sums into a new one of one batch, numbered as the newest. Readers move to ``to`` when it is complete."""
    log = read_log(spark, path, ddl)
    newest = log.agg(F.max(BATCH)).first()[0]
    if newest is not None:
        log_part(partials.added(log, list(keys), list(sums)), to, ["parent_asin"], newest, n)


def current_tags(spark: SparkSession, tags_path: str, log_path: str) -> DataFrame:
    """Tags after ``stream_tags``: of a review that a response covered the tags of its newest batch, else the stored ones."""
    done = table(spark, f"{log_path}/done", "review_id string, batch bigint").groupBy("review_id").agg(F.max("batch").alias("batch"))
    fresh = table(spark, f"{log_path}/tags", StructType([*SCHEMAS["review_tags"].fields, StructField("batch", LongType())]))
    newest = fresh.join(done, ["review_id", "batch"], "left_semi").drop("batch").dropDuplicates(["review_id", "tag_id"])
    stored = table(spark, tags_path, "review_tags").join(done, "review_id", "left_anti")
    return stored.unionByName(newest)


def stream_tags(
    lines: DataFrame, products: DataFrame, mapping: DataFrame, reviews_path: str, tags_path: str, log_path: str, stats_path: str, checkpoint: str
) -> StreamingQuery:
    """Model responses (column ``value``) to tags, then the statistics of the families they touch, in one chained batch.

    Reviews and tags are read by path in every batch, so rows added meanwhile count. A batch appends its tags and the reviews it covers
    under its number; ``current_tags`` takes the newest, so a replayed batch changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        reviews = table(spark, reviews_path, "reviews")
        none = spark.createDataFrame([], SCHEMAS["review_tags"])
        items = tags.tag_items(df).persist(StorageLevel.MEMORY_AND_DISK)
        mark = F.lit(number).cast("bigint").alias("batch")
        try:
            fresh, done = tags.ingest_tags(items, reviews, none)
            conform(fresh, "review_tags").select("*", mark).write.mode("append").parquet(f"{log_path}/tags")
            done.select("review_id", mark).write.mode("append").parquet(f"{log_path}/done")
            touched = reviews.join(done, "review_id", "left_semi").select(F.col("parent_asin").alias("asin")).distinct()
            now = current_tags(spark, tags_path, log_path)
            stats.product_stats(products, reviews, now, mapping, touched).select("*", mark).write.mode("append").parquet(stats_path)
        finally:
            items.unpersist()

    return _start(lines, batch, checkpoint)


def compact(spark: SparkSession, path: str, keys: Sequence[str], to: str) -> None:
    """Write the newest row of every key of a log as a new log of few files, which later batches may be appended to. Readers move
    to ``to`` when it is complete; the old folder is left alone."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch")]
    keep_one(log, list(keys), [F.desc("batch"), *[F.desc_nulls_last(c) for c in values]]).write.parquet(to)


def _windowed(stream: DataFrame, ts: str, delay: str, width: str, keys: Sequence[str], aggs: Sequence, path: str, checkpoint: str) -> StreamingQuery:
    """Windowed sums in update mode: each batch appends the windows it changed. Rows later
    than ``delay`` behind the newest one are dropped, which also bounds the state. Windows
    follow the wall clock of ``ts``: a day starts at its midnight in any session time zone."""
    zone = F.current_timezone()
    clock = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    timed = stream.withColumn("_clock", clock).withWatermark("_clock", delay)
    sums = timed.groupBy(F.window("_clock", width).alias("w"), *keys).agg(*aggs)

    def wall(edge: str) -> Column:
        return F.to_utc_timestamp(F.col(f"w.{edge}"), zone).cast("timestamp_ntz").alias(f"window_{edge}")

    flat = sums.select(wall("start"), wall("end"), *[c for c in sums.columns if c != "w"])

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(path)

    return _start(flat, batch, checkpoint, "update")


def stream_spend(charges: DataFrame, path: str, checkpoint: str, delay: str = "1 day", width: str = "1 day") -> StreamingQuery:
    """Spend per user and window."""
    paid = charges.filter(F.col("cost_usd") > 0)
    aggs = [F.sum("cost_usd").alias("spend"), F.count("*").alias("charges")]
    return _windowed(paid, "timestamp", delay, width, ["user_id"], aggs, path, checkpoint)


def stream_event_counts(events: DataFrame, path: str, checkpoint: str, delay: str = "1 day", width: str = "1 day") -> StreamingQuery:
    """Events per type and window."""
    return _windowed(events, "ts", delay, width, ["event_type"], [F.count("*").alias("events")], path, checkpoint)
