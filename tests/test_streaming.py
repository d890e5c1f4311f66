"""Streams: several batches give the batch result; repeats, restarts and late rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import stats
from reviewatlas.plans import streams
from reviewatlas.plans.fixtures import Tables
from reviewatlas.schemas import conform
from reviewatlas.streaming import jobs

RAW = "reviewId string, asin string, variationId string, rating string, date string, text string"


def put(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def review(key, asin="S", child="c1", rating="5.0 out of 5", date="on March 5, 2025"):
    return {"reviewId": key, "asin": asin, "variationId": child, "rating": rating, "date": date}


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_ingest_in_batches(spark, tmp_path, frame, delay):
    src = tmp_path / "src"
    products = frame([("c1", "P")], "asin string, parent_asin string")
    parents = frame([("P",)], "parent_asin string")
    out, heads, check = (str(tmp_path / n) for n in ("reviews", "parents", "check"))

    def run():
        stream = jobs.read_files(spark, str(src), "json", RAW, "*.jsonl", per_batch=1)
        jobs.stream_ingest(stream, products, parents, out, heads, check, delay).awaitTermination()

    put(src, "a.jsonl", [review("r1"), review("r2", child="zz"), review(None), review("r9", date="bad")])
    put(src, "b.jsonl", [review("r1"), review("r3", asin="T", child=None)])
    run()
    put(src, "c.jsonl", [review("r2", child="zz"), review("r4", child="zz")])
    run()
    got = spark.read.parquet(out)
    assert rows(got, "review_id", "parent_asin") == [("r1", "P"), ("r2", "S"), ("r3", "T"), ("r4", "S")]
    assert rows(spark.read.parquet(heads), "parent_asin") == [("S",), ("T",)]
    assert {r.rating_score for r in got.collect()} == {5.0}
    run()
    assert spark.read.parquet(out).count() == 4


def test_late_charges(spark, tmp_path):
    src = tmp_path / "src"
    day = lambda d: dt.datetime(2024, 1, d, 12).isoformat()
    schema = "user_id bigint, cost_usd double, timestamp timestamp"

    def run():
        stream = jobs.read_files(spark, str(src), "json", schema, "*.json", per_batch=1)
        jobs.stream_spend(stream, str(tmp_path / "out"), str(tmp_path / "check"), delay="1 day").awaitTermination()

    put(src, "1.json", [{"user_id": 1, "cost_usd": 1.0, "timestamp": day(1)}, {"user_id": 1, "cost_usd": -5.0, "timestamp": day(1)}])
    run()
    put(src, "2.json", [{"user_id": 1, "cost_usd": 2.0, "timestamp": day(2)}, {"user_id": 1, "cost_usd": 4.0, "timestamp": day(1)}])
    run()
    put(src, "3.json", [{"user_id": 2, "cost_usd": 1.0, "timestamp": day(9)}])
    run()
    put(src, "4.json", [{"user_id": 1, "cost_usd": 8.0, "timestamp": day(1)}])
    run()
    spend = jobs.latest(spark.read.parquet(str(tmp_path / "out")), ["window_start", "window_end", "user_id"])
    got = rows(spend.select(F.dayofmonth("window_start").alias("d"), "user_id", "spend"))
    assert got == [(1, 1, 5.0), (2, 1, 2.0), (9, 2, 1.0)]


def test_status_log(spark, tmp_path, frame):
    src = str(tmp_path / "src")
    ddl = "k string, status string, seq bigint"
    for batch in ([("r1", "PENDING", 1), ("r2", "PENDING", 1)], [("r1", "QUEUED", 2)], [("r1", "COMPLETED", 3), ("r2", "QUEUED", 2)]):
        frame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_files(spark, src, "parquet", ddl, "*.parquet", per_batch=1)
    jobs.stream_status(stream, "k", str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert rows(jobs.current_status(spark, str(tmp_path / "log"), "k"), "k", "status") == [("r1", "COMPLETED"), ("r2", "QUEUED")]


def test_recalculation_touches_only_changed_families(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    src = str(tmp_path / "src")
    for family in ("A000000010", "A000000020"):
        t.reviews.filter(F.col("parent_asin") == family).select("parent_asin").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_files(spark, src, "parquet", "parent_asin string", "*.parquet", per_batch=1)
    jobs.stream_stats(stream, t.products, t.reviews, t.review_tags, t.aspect_mapping, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = jobs.latest(spark.read.parquet(str(tmp_path / "out")), ["asin"])
    want = stats.product_stats(t.products, t.reviews, t.review_tags, t.aspect_mapping).filter(F.col("asin").isin("A000000010", "A000000020"))
    assert rows(stats.stats_json(got)) == rows(stats.stats_json(want))
    assert got.count() == 2


def test_history_is_read_by_month_only(spark, tmp_path):
    path = str(tmp_path / "reviews")
    old = spark.createDataFrame([(f"r{m}", f"2020-{m:02d}-03") for m in range(1, 13)], "review_id string, d string")
    old = conform(old.select("review_id", F.to_date("d").alias("review_date")), "reviews")
    old.withColumn(jobs.MONTH, jobs.month_of("review_date")).write.partitionBy(jobs.MONTH).parquet(path)
    batch = old.filter("review_id IN ('r2', 'r7')")
    held = jobs.history(spark, path, batch)
    assert rows(held, "review_id") == [("r2",), ("r7",)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [review_month" in plan and "2020-07" in plan and "2020-08" not in plan


def test_tag_stream_chains_the_statistics_and_survives_a_replay(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    base = streams._tagged(t)
    now = jobs.current_tags(spark, f"{base}/old", f"{base}/log")
    assert now.count() == now.select("review_id", "tag_id").distinct().count()
    saved = jobs.latest(spark.read.parquet(f"{base}/stats"), ["asin"])
    touched = spark.read.parquet(f"{base}/log/done").select("review_id").distinct().join(t.reviews, "review_id").select(F.col("parent_asin").alias("asin")).distinct()
    want = stats.product_stats(t.products, t.reviews, now, t.aspect_mapping, touched)
    assert rows(stats.stats_json(saved)) == rows(stats.stats_json(want)) != []
