"""Long texts are carried by their digest: what is moved does not grow with them, and results stay whole."""

from __future__ import annotations

import datetime
import os
import random

import pytest

from reviewatlas.functions.frames import apart, whole
from reviewatlas.operators import compare, evidence, linkage, quality
from reviewatlas.sources import readers, writers

SIZE, N = 20_000, 240


@pytest.fixture
def plain_plans(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("false", "-1", "2"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def _texts():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghij ", k=SIZE)) for _ in range(2)]


def _moved(df):
    """(rows, bytes that the exchanges of the plan wrote)."""
    rows = df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        size = node.metrics().get("dataSize")
        total += size.get().value() if size.isDefined() else 0
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
    return rows, total


def _tags(spark, texts):
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"R{i}#1", f"R{i}", f"A{i % 3}", "Quality", ("red", "blue")[i % 2], "Negative", day, None if i % 40 == 0 else texts[i % 2]) for i in range(N)]
    return spark.createDataFrame(rows, "tag_id string, review_id string, parent_asin string, category string, aspect string, sentiment string, created_at timestamp_ntz, quote string").repartition(2)


def _mapping(spark):
    return spark.createDataFrame([("red", "Red", "Quality")], "raw_aspect string, standard_aspect string, category string")


def _reviews(spark, texts):
    rows = [(f"R{i}", f"A{i % 3}", f"C{i}", "v", datetime.date(2024, 1, 1 + i % 28), "t", None if i % 40 == 0 else texts[i % 2]) for i in range(N)]
    return spark.createDataFrame(rows, "review_id string, parent_asin string, child_asin string, variation_text string, review_date date, title string, text string").repartition(2)


def test_texts_come_back(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "")], "id int, text string")
    parts = apart(rows, "text")
    back = whole(*parts, "text")
    assert back.columns == rows.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert parts[1].count() == 3


@pytest.mark.parametrize("name", ["evidence_board", "search_evidence", "dedup_tags", "dedup_stats", "swot", "link_reviews"])
def test_texts_are_not_moved_by_row(spark, plain_plans, name):
    texts = _texts()
    tags, mapping, reviews = _tags(spark, texts), _mapping(spark), _reviews(spark, texts)
    # the input's own exchange is not the operator's
    base = spark.createDataFrame(tags.collect(), tags.schema), spark.createDataFrame(reviews.collect(), reviews.schema)
    products = spark.createDataFrame([("C1", "A9")], "asin string, parent_asin string")
    run = {
        "evidence_board": lambda: evidence.evidence_board(base[0], mapping),
        "search_evidence": lambda: evidence.search_evidence(base[0], base[1], mapping, keywords="abc, j", k=500),
        "dedup_tags": lambda: quality.dedup_tags(base[0], mapping),
        "dedup_stats": lambda: quality.dedup_stats(base[0]),
        "swot": lambda: compare.swot(base[0], mapping),
        "link_reviews": lambda: linkage.link_reviews(base[1], base[1].filter("review_id = 'R5'"), products, products.select("parent_asin"))[0],
    }
    rows, moved = _moved(run[name]())
    column = {"swot": "sample_complaint", "link_reviews": "text", "dedup_stats": None}.get(name, "quote")
    if column:
        assert {r[column] for r in rows} >= set(texts if name != "swot" else [])
    expected = {"evidence_board": N, "search_evidence": N - 6, "dedup_tags": N, "link_reviews": N - 1}
    if name in expected:
        assert len(rows) == expected[name]
    assert moved < N * SIZE / 4


def test_swot_compares_quotes_with_a_common_beginning(spark):
    day = datetime.datetime(2024, 1, 1)
    quotes = ["x" * 70 + "b", "x" * 70 + "a", "x" * 80, None, "y"]
    rows = [(f"R{i}#1", f"R{i}", "A1", "Quality", "red", "Negative", day, q) for i, q in enumerate(quotes)]
    tags = spark.createDataFrame(rows, _tags(spark, ["", ""]).schema)
    found = compare.swot(tags, _mapping(spark)).collect()
    assert [r["sample_complaint"] for r in found] == ["x" * 70 + "a"]


def test_ndjson_is_compressed_in_files_of_limited_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 10)
    rows = spark.createDataFrame([(i, "same text " * 200) for i in range(25)], "id int, text string").coalesce(1)
    writers.write_ndjson(rows, str(tmp_path / "out"))
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert len(files) == 3
    assert all(f.endswith(".json.lz4") for f in files)
    assert sum(os.path.getsize(tmp_path / "out" / f) for f in files) < 25 * 2000 / 4
    back = readers.read_ndjson(spark, str(tmp_path / "out"), rows.schema).select("id", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_quotes_found_by_the_index_are_not_moved_by_row(spark, plain_plans, tmp_path):
    from reviewatlas.operators import textindex

    texts = _texts()
    tags, reviews = _tags(spark, texts), _reviews(spark, texts)
    tags, reviews = spark.createDataFrame(tags.collect(), tags.schema), spark.createDataFrame(reviews.collect(), reviews.schema)
    path = str(tmp_path / "index")
    textindex.add(reviews.select("text"), path, 0, 4)
    keyed = tags.withColumn("quote_key", textindex.key_of("quote")), reviews.withColumn("text_key", textindex.key_of("text")).drop("text")
    rows, moved = _moved(textindex.search_evidence(spark, path, *keyed, _mapping(spark), "abc, j", k=500))
    plain = evidence.search_evidence(tags, reviews, _mapping(spark), keywords="abc, j", k=500).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, plain)) and len(rows) == N - 6
    assert moved < N * SIZE / 4


def test_the_index_makes_its_texts_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from reviewatlas.operators import textindex

    made = spark.sparkContext.accumulator(0)

    def counted(n):
        made.add(1)
        return f"text {n}"

    texts = spark.range(20).select(F.udf(counted, "string").asNondeterministic()("id").alias("text"))
    textindex.add(texts, str(tmp_path / "index"), 0, 4)
    assert made.value == 20


def test_a_digest_has_sixteen_bytes(spark):
    from pyspark.sql import functions as F

    rows, texts = apart(spark.createDataFrame([("a",), ("b",), (None,)], "text string"), "text")
    assert sorted(r[0] or 0 for r in rows.select(F.length("text")).collect()) == [0, 16, 16]
    assert texts.select("_key").distinct().count() == 2


def test_cleaned_streams_are_packed(spark):
    import pyarrow.parquet as pq

    from reviewatlas.plans import registry

    files = registry.runner("stream_clean")(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_tags_meet_their_texts_without_ids_and_names(spark):
    """What the joins of the tags move is made of stored numbers: no exchange but the last ones carries an id that was written out."""
    from reviewatlas.plans.fixtures import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").review_tags_quoted._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "AS tag_id" in plan[: plan.index("Join")] and "AS tag_id" not in below and "AS parent_asin" not in below
