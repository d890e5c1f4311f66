"""Files: formats, names, quarantine, snapshots."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewatlas.operators.clean import clean_metadata, clean_products, clean_reviews
from reviewatlas.schemas import SCHEMAS, conform
from reviewatlas.session import scratch_path
from reviewatlas.sources import readers, writers


def test_json_array_and_nested_products(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"asin": "A1", "n": 1},\n {"asin": "A2"}]')
    assert rows(readers.read_json_arrays(spark, str(tmp_path), "asin string, n int")) == [("A1", 1), ("A2", None)]


def test_scrapes_with_bad_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"statusCode": 200, "title": "t"}\n\n{oops\n{"statusCode": 404, "title": "x"}\n{"statusCode": 200, "title": ""}\n')
    good, bad = readers.read_scrapes(spark, str(tmp_path), StructType.fromDDL("statusCode int, title string"))
    assert rows(good) == [(200, "t")]
    assert rows(bad) == [("{oops",)]


def test_feed_ids_stay_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text('post_id,text,views\n0071,"two\nlines",5\n')
    assert rows(readers.read_feed(spark, str(tmp_path), {"post_id": "bigint", "text": "string", "views": "bigint"})) == [("0071", "two\nlines", 5)]


def test_files_by_name_content_and_size(spark, tmp_path):
    (tmp_path / "raw_scrape_1.csv").write_text("asin\nA\nB\n")
    (tmp_path / "other.csv").write_text("asin\nA\n")
    (tmp_path / "raw_scrape_2.txt").write_text("asin\nA\n")
    every = readers.read_matching(spark, str(tmp_path), "csv", "asin string", "*.csv")
    named = readers.read_matching(spark, str(tmp_path), "csv", "asin string", "*.csv", ["raw_scrape", "Scraper_Data"])
    assert rows(named, "asin") == [("A",), ("B",)]
    targets = spark.createDataFrame([("A",)], "asin string")
    base = f"file:{tmp_path}"
    assert rows(readers.files_holding(every, targets, "asin"), "file", "rows") == [(f"{base}/other.csv", 1), (f"{base}/raw_scrape_1.csv", 1)]
    assert rows(readers.files_by_row_count(every, [2])) == [(f"{base}/raw_scrape_1.csv", 2)]


def test_files_of_equal_names_are_told_apart(spark, tmp_path):
    for folder, ids in (("a", "AB"), ("b", "CDE")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.csv").write_text("asin\n" + "\n".join(ids) + "\n")
    every = readers.read_matching(spark, f"{tmp_path}/*", "csv", "asin string")
    assert [r.rows for r in readers.files_by_row_count(every, [2, 3]).orderBy("rows").collect()] == [2, 3]
    assert readers.files_by_row_count(every, [5]).count() == 0


def test_csv_keeps_quotes_commas_breaks_and_backslashes(spark, tmp_path):
    titles = ['5" pan, "big"', "two\nlines", "back\\slash", '\\"', '"', "plain", None]
    path = f"{tmp_path}/sheet"
    writers.write_csv(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), path)
    assert rows(readers.read_sheet(spark, path, "id int, title string")) == rows(spark.createDataFrame(list(enumerate(titles)), "id int, title string"))
    assert rows(readers.read_sheet_as_text(spark, path), "title") == rows(spark.createDataFrame([(t,) for t in titles], "title string"))
    assert rows(readers.read_matching(spark, path, "csv", "id int, title string"), "title") == rows(spark.createDataFrame([(t,) for t in titles], "title string"))


def test_sql_and_attached_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert readers.query_one(spark, "SELECT max(n) FROM {t} WHERE k <> :k", {"k": "b"}, t=df) == 1
    assert readers.query_one(spark, "SELECT n FROM {t} WHERE k = 'none'", t=df) is None
    df.write.parquet(str(tmp_path / "items"))
    readers.attach(spark, str(tmp_path), ["items"], "backup")
    assert spark.table("backup_items").count() == 2


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.current(spark, base)
    assert writers.publish(spark.range(3).toDF("id"), base) == 1
    # the next version may be computed from the current one
    assert writers.publish(writers.current(spark, base).filter("id > 0"), base) == 2
    assert (writers.current(spark, base).count(), writers.current(spark, base, 1).count()) == (2, 3)


def test_failed_publish_leaves_readers(spark, tmp_path):
    base = str(tmp_path / "t")
    writers.publish(spark.range(3).toDF("id"), base)
    with pytest.raises(Exception):
        writers.publish(spark.range(3).select(F.raise_error(F.lit("boom")).alias("id")), base)
    assert writers.current(spark, base).count() == 3


def test_conform(spark):
    df = spark.createDataFrame([("7", "x")], "HELPFUL_COUNT string, other string")
    out = conform(df, SCHEMAS["reviews"], defaults={"mining_status": "PENDING"})
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in SCHEMAS["reviews"]]
    assert rows(out, "helpful_count", "mining_status", "review_id") == [(7, "PENDING", None)]
    assert rows(conform(df, SCHEMAS["reviews"], {"OTHER": "title"}), "title") == [("x",)]


def test_review_file_edges(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text(
        '{"reviewId": "r1", "rating": "4.0 out of 5 stars", "date": "Reviewed in the United States on March 5, 2025", "verified": "TRUE", "variationList": ["Red"], "numberOfHelpful": "x"}\n'
        '{"reviewId": "r2", "rating": null, "date": "nowhere"}\n{"rating": "1", "date": "on March 5, 2025"}\n'
    )
    schema = "reviewId string, rating string, date string, verified string, numberOfHelpful string, variationList array<string>"
    got = clean_reviews(readers.read_ndjson(spark, str(tmp_path), schema))
    assert rows(got, "review_id", "rating_score", "is_verified", "vine_program", "helpful_count", "variation_text", "source_file", "mining_status") == [
        ("r1", 4.0, True, False, None, "Red", "raw.jsonl", "PENDING")
    ]


def test_product_layouts(spark):
    kid = spark.createDataFrame([("A1", "P1", "Quilt", "Brand: X", "n1", "n2", "4.5 stars", "7")], "asin string, parentAsin string, title string, brand string, niche string, `Main Niche` string, productRating string, countRatings string")
    assert rows(clean_products(kid), "asin", "parent_asin", "brand", "main_niche", "real_average_rating", "real_total_ratings", "category") == [("A1", "P1", "X", "n1", 4.5, 7, "comforter")]
    book = spark.createDataFrame([("A1", "Drawing tumbler", "by Z (Author)", "9")], "asin string, title string, manufacturer string, countReview string").withColumn("productDetails", F.array())
    assert rows(clean_products(book), "brand", "category", "real_total_ratings") == [("Z", "book", 9)]
    plain = spark.createDataFrame([("A1", "Name", "X Store")], "asin string, productTitle string, brand string")
    assert rows(clean_products(plain, "tumbler"), "title", "brand", "category") == [("Name", "X", "tumbler")]


def test_attribute_columns(spark):
    raw = spark.sql("""SELECT 'x/dp/B000000001' AS url, 'B000000002' AS asin, 't' AS title, 200 AS statusCode, array('i') AS imageUrlList, '4.1' AS productRating, 5 AS countReview,
        array(named_struct('name', 'Fabric Type', 'value', 'wool'), named_struct('name', 'Material Composition', 'value', ' cotton '), named_struct('name', 'Size', 'value', '')) AS productDetails""")
    assert rows(clean_metadata(raw), "asin", "parent_asin", "material", "size_capacity", "real_average_rating") == [
        ("B000000002", "B000000001", "wool | cotton | cotton", None, 4.1)
    ]


def test_scratch_path_uses_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert path.startswith(shared)
    assert path != scratch_path(spark, "x")


def test_lines_are_compressed_in_files_of_limited_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 4)
    writers.write_lines(spark.range(10).selectExpr("IF(id = 3, '', 'line ' || id) AS value", "id").coalesce(1), str(tmp_path / "lines"))
    names = [f.name for f in (tmp_path / "lines").iterdir() if f.name.startswith("part-")]
    assert len(names) == 3 and all(n.endswith(".txt.lz4") for n in names)
    assert rows(spark.read.text(str(tmp_path / "lines"))) == sorted([("" if i == 3 else f"line {i}",) for i in range(10)])
