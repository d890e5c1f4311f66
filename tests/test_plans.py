"""Physical plans: what must not be in them, and what must."""

from __future__ import annotations

import re

import pytest

from reviewatlas.plans import registry
from reviewatlas.plans.fixtures import Tables

SF_DIR = "/root/testdata/sf0.001"
# all but those that write files or run streams while they are built, and the tools, which meet one literal row
BATCH = sorted(n for n, q in registry.load().items() if not q.build.__module__.endswith((".tables", ".streams", ".named", ".tools", ".sqltools", ".bucketed", ".moving", ".searching", ".sessions")))


def plan_of(spark, name):
    df = registry.load()[name].build(Tables(spark, SF_DIR))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_pairing(spark, name):
    """No Python in the hot path, and no join that forms all pairs, also where nothing is
    small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert bad not in plan, bad


def test_columns_and_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, "star_counts")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_extendedprice" in schema  # part of the tie order
    assert "l_discount" not in schema and "l_returnflag" not in schema
    df = Tables(spark, SF_DIR).raw("orders").filter("o_orderkey > 10").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in df._jdf.queryExecution().executedPlan().toString()


def test_one_product_filter_reaches_the_scan(spark):
    """A single answer is a filter on the set-wise plan: it moves below the aggregations."""
    df = registry.load()["estimated_impact"].build(Tables(spark, SF_DIR)).filter("parent_asin = 'A000000010'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert plan[window:].count("A000000010") >= 2


def test_reviews_are_written_after_the_shuffle(spark, tmp_path):
    from reviewatlas.plans.fixtures import Tables

    row = "{n} AS l_orderkey, 7L AS l_partkey, 3L AS l_suppkey, 1 AS l_linenumber, {q} AS l_quantity, 2.0D AS l_extendedprice, 'N' AS l_returnflag, 'O' AS l_linestatus, {d} AS l_shipdate"
    rows = [("1L", "4.0D", "timestamp_ntz'2024-01-02 03:00:00'"), ("1L", "3.0D", "timestamp_ntz'2024-01-01 05:00:00'"), ("CAST(NULL AS BIGINT)", "1.0D", "timestamp_ntz'2024-01-01 00:00:00'")]
    spark.sql(" UNION ALL ".join("SELECT " + row.format(n=n, q=q, d=d) for n, q, d in rows)).write.parquet(str(tmp_path / "lineitem.parquet"))
    reviews = Tables(spark, str(tmp_path)).reviews
    below = reviews._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert "author_name" not in below and "child_asin" not in below
    got = {(r.review_id, r.parent_asin, r.child_asin, r.author_name, r.rating_score, str(r.review_date)) for r in reviews.collect()}
    assert got == {("R1_1", "A000000005", "A000000007", "U3", 4.0, "2024-01-01"), (None, "A000000005", "A000000007", "U3", 2.0, "2024-01-01")}
