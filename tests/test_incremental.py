"""The id index and the partial sums: several batches, repeated batches, replaced tags, and what a batch reads."""

from __future__ import annotations

import json
import re

from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import partials, stats
from reviewatlas.schemas import conform
from reviewatlas.streaming import jobs

RAW = "reviewId string, asin string, variationId string, rating string, date string, text string"
N = 4


def review(key, date, child="c1"):
    return {"reviewId": key, "asin": "S", "variationId": child, "rating": "4.0 out of 5", "date": f"on {date}"}


def put(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def forget_last(check):
    """As after a stop between the work of a batch and the note that it is done."""
    last = max((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (check / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


def test_an_id_that_returns_under_another_month(spark, tmp_path, frame):
    src, check = tmp_path / "src", tmp_path / "check"
    out, heads, index = (str(tmp_path / p) for p in ("reviews", "parents", "index"))
    products, parents = frame([("c1", "P")], "asin string, parent_asin string"), frame([("P",)], "parent_asin string")
    stored = frame([("old1", "2020-02-03"), ("old2", "2020-03-03")], "review_id string, d string")
    jobs.add_to_index(conform(stored.select("review_id", F.to_date("d").alias("review_date")), "reviews"), index, -1, N)

    def run():
        stream = jobs.read_files(spark, str(src), "json", RAW, "*.jsonl")
        jobs.stream_ingest(stream, products, parents, out, heads, str(check), index=index, n=N).awaitTermination()

    put(src, "a.jsonl", [review("old1", "May 5, 2024"), review("r1", "March 5, 2025"), review("r1", "April 5, 2025"), review("r2", "March 6, 2025")])
    run()
    put(src, "b.jsonl", [review("r1", "June 5, 2026"), review("r2", "March 6, 2025"), review("r3", "March 7, 2025"), review("old2", "March 3, 2020")])
    run()
    want = [("r1", "2025-03"), ("r2", "2025-03"), ("r3", "2025-03")]
    assert rows(spark.read.parquet(out), "review_id", "review_month") == want
    forget_last(check)
    run()
    assert rows(spark.read.parquet(out), "review_id", "review_month") == want
    held = jobs.read_log(spark, index, jobs.INDEX)
    assert rows(held, "review_id", "review_month", "batch") == [
        ("old1", "2020-02", -1), ("old2", "2020-03", -1), ("r1", "2025-03", 0), ("r2", "2025-03", 0), ("r3", "2025-03", 1)]
    assert rows(held.filter("batch >= 0"), "parent_asin", "star") == [("P", 4)] * 3


def test_a_batch_reads_the_buckets_of_its_ids(spark, tmp_path, frame):
    index = str(tmp_path / "index")
    old = frame([(f"r{i}", "2020-01-05") for i in range(60)], "review_id string, d string")
    jobs.add_to_index(conform(old.select("review_id", F.to_date("d").alias("review_date")), "reviews"), index, -1, 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = jobs.known_ids(spark, index, frame([("r7",), (None,)], "review_id string"), 16, before=3)
    assert ("r7",) in rows(found, "review_id") and found.count() < 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "bucket#" in filters and "batch#" in filters
    assert "ReadSchema: struct<review_id:string,parent_asin:string,star:int,review_month:string>" in plan


TAGS = "review_id string, tag_id string, parent_asin string, aspect string, sentiment string, star int"


def test_sums_follow_replaced_tags_and_repeated_batches(spark, tmp_path, frame):
    paths = {p: str(tmp_path / p) for p in ("tags", "log", "parts", "rparts", "docs", "src")}
    products = frame([("A", "A", 100, 4.0, 1, None), ("B", "B", None, None, None, '{"5": 50, "1": 50}')],
                     "asin string, parent_asin string, real_total_ratings bigint, real_average_rating double, variation_count int, rating_breakdown string")
    mapping = frame([("big", "Size", "Fit")], "raw_aspect string, standard_aspect string, category string")
    reviews = frame([("r1", "A", "a1", "2024-01-05", 5.0), ("r2", "A", "a2", "2024-02-05", 1.0), ("r3", "B", "b1", "2024-02-06", 5.0), ("r4", "B", "b1", "2024-02-07", None)],
                    "review_id string, parent_asin string, child_asin string, d string, rating_score double").withColumn("review_date", F.to_date("d")).drop("d")
    tag = lambda r, k, aspect, mood, family, star: (r, f"{r}#{k}", family, aspect, mood, star)
    final = [tag("r1", 1, "big", "Positive", "A", 5), tag("r1", 2, "Size", "Positive", "A", 5), tag("r2", 1, "big", "Negative", "A", 1), tag("r2", 2, "soft", "Neutral", "A", 1),
             tag("r4", 1, "soft", "Negative", "B", None), tag("r4", 2, "soft", "Positive", "B", None)]
    gone = [tag("r1", 9, "loud", "Negative", "A", 5), tag("r3", 1, "loud", "Positive", "B", 5), tag("r3", 2, "loud", "Positive", "B", 5)]
    batches = [gone + final[2:4], final[:2] + [("r3", None, None, None, None, None)], final[4:] + final[4:]]

    reviews.write.parquet(paths["src"])
    jobs.stream_review_parts(jobs.read_files(spark, paths["src"], "parquet", reviews.schema, "*.parquet"), paths["rparts"], str(tmp_path / "c1"), N).awaitTermination()

    def run():
        stream = jobs.read_files(spark, paths["tags"], "parquet", TAGS, "*.parquet")
        jobs.stream_tag_parts(stream, paths["log"], paths["parts"], str(tmp_path / "c2"), N).awaitTermination()

    for part in batches:
        frame(part, TAGS).coalesce(1).write.mode("append").parquet(paths["tags"])
        run()
        # the batch is done again, as if its end had not been noted
        forget_last(tmp_path / "c2")
        run()
    jobs.stream_documents(spark, paths["rparts"], paths["parts"], products, mapping, paths["docs"], str(tmp_path / "c3"), N).awaitTermination()
    tagged = frame(final, TAGS)
    want = rows(stats.stats_json(stats.product_stats(products, reviews, tagged, mapping)))
    assert rows(stats.stats_json(jobs.latest(spark.read.parquet(paths["docs"]), ["asin"]))) == want
    assert rows(stats.stats_json(jobs.documents(spark, paths["rparts"], paths["parts"], products, mapping, n=N))) == want
    one = jobs.documents(spark, paths["rparts"], paths["parts"], products, mapping, frame([("B",)], "parent_asin string"), N)
    assert rows(stats.stats_json(one)) == [r for r in want if r[0] == "B"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().executedPlan().toString())
    # what was replaced is gone from the sums, and a compacted log says the same
    sums = partials.added(jobs.read_log(spark, paths["parts"], partials.TAG_SCHEMA), partials.TAG_KEYS, partials.TAG_SUMS)
    assert not sums.filter("aspect = 'loud'").count()
    jobs.compact_parts(spark, paths["parts"], partials.TAG_SCHEMA, partials.TAG_KEYS, partials.TAG_SUMS, str(tmp_path / "few"), N)
    assert rows(jobs.read_log(spark, str(tmp_path / "few"), partials.TAG_SCHEMA).drop("bucket", "batch")) == rows(sums)


def test_review_sums_cancel_exactly(frame):
    old = frame([("A", "a", "2024-01-01", 4.1), ("A", "a", "2024-01-02", 4.4), ("A", "b", "2024-01-02", 0.3)], "parent_asin string, child_asin string, d string, rating_score double")
    old = old.withColumn("review_date", F.to_date("d"))
    both = partials.review_parts(old).unionByName(partials.review_parts(old.filter("child_asin = 'a'"), -1))
    assert rows(partials.added(both, partials.REVIEW_KEYS, partials.REVIEW_SUMS).select("child_asin", "n", F.col("score").cast("string"))) == [("b", 1, "0.300000")]


def test_months_are_written_side_by_side_and_packed(spark, tmp_path, frame, monkeypatch):
    import pyarrow.parquet as pq

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], jobs.overwrite_partitions
    before = spark.conf.get(name)

    def spied(df, path, by, **options):
        if jobs.MONTH in by:
            seen.append(df.sparkSession.conf.get(name))
        write(df, path, by, **options)

    monkeypatch.setattr(jobs, "overwrite_partitions", spied)
    products, parents = frame([("c1", "P")], "asin string, parent_asin string"), frame([("P",)], "parent_asin string")
    records = [{**review(f"r{i}", f"March 5, {1900 + i}"), "text": f"text {i % 3}"} for i in range(jobs.OPEN_MONTHS + 20)]
    put(tmp_path / "src", "a.jsonl", records)
    for kind, more in (("by_month", {"by_month": True}), ("indexed", {"index": str(tmp_path / "index"), "n": N})):
        out, heads, check = (str(tmp_path / kind / p) for p in ("reviews", "parents", "check"))
        stream = jobs.read_files(spark, str(tmp_path / "src"), "json", RAW, "*.jsonl")
        jobs.stream_ingest(stream, products, parents, out, heads, check, **more).awaitTermination()
        assert rows(spark.read.parquet(out), "review_id", "review_month", "text") == sorted((f"r{i}", f"{1900 + i}-03", f"text {i % 3}") for i in range(len(records)))
        files = list((tmp_path / kind / "reviews").rglob("*.parquet"))
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    # the setting is that of the batch's own session
    assert seen == [str(jobs.OPEN_MONTHS)] and spark.conf.get(name) == before
