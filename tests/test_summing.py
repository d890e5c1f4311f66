"""Levels, sketches, feeds of changing shape and SQL functions on small rows and against their plain counterparts."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import levels, quality, sketches
from reviewatlas.plans import sqltools, tools
from reviewatlas.plans.fixtures import Tables
from reviewatlas.sources import variants


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_levels_equal_the_separate_operators(t):
    found = levels.catalogue_levels(t.products, t.reviews)
    by_category = found.filter("level = 'category'")
    want = quality.coverage_by_category(t.products, t.reviews)
    assert rows(by_category.select("category", F.col("products").alias("cnt"), "has_meta")) == rows(want.select("category", "cnt", "has_meta"))
    assert rows(by_category.select("category", "products", "has_breakdown")) == rows(quality.audit_products(t.products).select("category", "total_asins", "have_breakdown"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3 and plan.count("Expand") == 1  # parts, and line items for counts behind the deduplication


def test_null_keys_are_not_levels(frame):
    products = frame([("a", None, None, "a", 1, None), ("b", "C", None, "a", None, "{}")], "asin string, category string, main_niche string, parent_asin string, real_total_ratings bigint, rating_breakdown string")
    got = levels.catalogue_levels(products, frame([("a", 5.0)], "parent_asin string, rating_score double"))
    assert rows(got.select("level", "category", "products", "reviews")) == sorted([
        ("all", None, 2, 1), ("category", None, 1, 1), ("category", "C", 1, 0), ("niche", None, 1, 1), ("niche", "C", 1, 0), ("family", None, 1, 1), ("family", "C", 1, 0),
    ], key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_sketches_of_days_keep_their_bounds(frame):
    rng = random.Random(3)
    data = [("k" if i % 3 else None, f"2024-01-{1 + i % 28:02d}", f"v{rng.randrange(20_000)}", rng.randrange(1_000_000)) for i in range(40_000)]
    df = frame(data, "k string, d string, v string, n bigint").withColumn("d", F.to_date("d")).repartition(6)
    days = sketches.daily(df, ["k"], "d", "v", "n")
    assert days.count() <= 2 * 28
    both = sketches.merged(days, ["k"]).select("k", "n", sketches.different("hll").alias("d"), sketches.quantile("kll", 0.9).alias("q"))
    for r in both.collect():
        mine = [x for x in data if x[0] == r["k"]]
        exact = len({x[2] for x in mine})
        assert r["n"] == len(mine) and abs(r["d"] - exact) <= sketches.DISTINCT_ERROR * exact
        assert abs(sum(x[3] <= r["q"] for x in mine) / len(mine) - 0.9) <= sketches.RANK_ERROR
    one = [sketches.merged(sketches.daily(df.filter(c).withColumn("one", F.lit(1)), ["one"], "d", "v"), ["one"]) for c in ("n < 600000", "n >= 300000")]
    got = sketches.overlap(*one, ["one"]).first()
    a, b = {x[2] for x in data if x[3] < 600000}, {x[2] for x in data if x[3] >= 300000}
    for name, exact in (("left_only", a - b), ("shared", a & b), ("right_only", b - a)):
        assert abs(got[name] - len(exact)) <= 2 * sketches.DISTINCT_ERROR * len(a | b), name
    empty = sketches.overlap(one[0], one[1].limit(0), ["one"]).first()
    assert empty["shared"] == 0 == empty["right_only"]


FIELDS = {"id": "string", "likes": "bigint", "author.name": "string", "url": "string"}
LINES = [
    '{"id":1,"likes":5,"author":{"name":"x"},"url":"u"}', '{"id":"2","likes":"1,204","author":[{"name":"y"},{"name":"z"}],"url":["u2"],"fresh":{"a":1}}',
    "not json", "[1]", '{"id":3.5,"likes":null,"author":"who","when":true}', '{"likes":7.9,"url":{"a":1}}', None, "",
]


def test_feeds_of_changing_shape(frame):
    records = variants.read_lines(frame([(x,) for x in LINES], "value string"))
    got = variants.shaped(records, FIELDS).select("id", "likes", "author.name", "url")
    assert rows(got) == sorted([("1", 5, "x", "u"), ("2", 1204, "y", "u2"), ("3.5", None, None, None), (None, 7, None, None)], key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert rows(variants.unreadable(records)) == [(None,), ("",), ("[1]",), ("not json",)]
    report = {(r["path"], r["seen"]): (r["records"], r["status"]) for r in variants.drift(records, FIELDS).collect()}
    assert report["author", "ARRAY"] == (1, "other type") and report["author", "OBJECT"] == (1, "expected") and report["author.name", "STRING"] == (2, "expected")
    assert report["fresh", "OBJECT"] == (1, "new") and report["likes", "STRING"] == (1, "other type") and ("likes", "VOID") not in report
    assert "author" in variants.whole_schema(records).first()[0]
    none = variants.read_lines(frame([], "value string"))
    assert rows(variants.drift(none, FIELDS)) == [] == rows(variants.shaped(none, FIELDS))
    with pytest.raises(ValueError, match="one level"):
        variants.shaped(records, {"a.b.c": "string"})


def test_sql_functions_equal_the_python_ones(spark, t):
    names = sqltools.register(t)
    assert len(names) == 8
    for name, said in {"get_product_swot": "'A000000012'", "generate_listing_content": "'A000000010'", "get_product_dna": "'nope'"}.items():
        want = tools.call(name, t, asin=said.strip("'"))
        got = spark.sql(f"SELECT * FROM {name}({said})")
        assert rows(got.select(*want.columns)) == rows(want), name
    found = spark.sql("SELECT f.aspect, count(*) AS n FROM get_product_swot('A000000012') f GROUP BY f.aspect")
    assert found.columns == ["aspect", "n"] and found.count()
