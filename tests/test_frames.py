"""Building blocks against brute force."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.functions import frames
from reviewatlas.functions.neighbours import containment_pairs, nearest_within


def test_nearest_within_is_exact(spark):
    rng = random.Random(5)
    points = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(3)}", rng.choice([0, 1, 2, 3, rng.randrange(50), rng.randrange(5000)]), f"k{i:04d}") for i in range(900)]
    bands, k = [(0.6, 1.4), (0.4, 1.6)], 4
    got = nearest_within(spark.createDataFrame(points, "g string, x bigint, id string"), ["g"], "x", "id", k, bands).collect()
    assert {(r.g, r.x) for r in got} == {(g, x) for g, x, _ in points}
    for r in got:
        for i, (lo, hi) in enumerate(bands):
            inside = [(abs(x - r.x), key) for g, x, key in points if g == r.g and r.x * lo <= x <= r.x * hi]
            assert [(e["diff"], e["key"]) for e in r[f"near_{i}"]] == sorted(inside)[: k + 1]


def test_containment_pairs_is_exact(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abC ") for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    needles = words[:60] + ["abcabcabc", "longer than all of them"]
    df = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} string")
    got = {tuple(r) for r in containment_pairs(df(needles, "n"), "n", df(words, "v"), "v", 4).select("n", "v").collect()}
    assert got == {(n, v) for n in needles for v in words if n.lower() in v.lower()}


def test_exact_median(spark):
    rng = random.Random(1)
    data = [(f"a{i % 4}", rng.choice([-5, 0, 1, 7, rng.randrange(10**6)])) for i in range(999)] + [("one", 3), ("two", 4), ("two", 9), ("none", None)]
    got = dict(tuple(r) for r in frames.exact_median(spark.createDataFrame(data, "k string, v bigint"), "k", "v", "m").collect())
    want = {k: float(statistics.median([v for key, v in data if key == k])) for k in {k for k, v in data if v is not None}}
    assert got == want


def test_previous_rows(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 3 else f"p{i % 5}", start + dt.timedelta(hours=rng.randrange(0, 2000)), i) for i in range(300)]
    got = rows(frames.previous_rows(spark.createDataFrame(data, "k string, t timestamp, v int"), "k", "t", ["v"]))
    want = []
    for key in {d[0] for d in data}:
        mine = sorted((t, v) for k, t, v in data if k == key)
        for prev, (t, v) in zip([(None, None), *mine], mine):
            want.append((key, t, v, *prev))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_prefix_lists_keep_all_in_order(spark):
    df = spark.range(2500).select(F.when(F.col("id") % 5 == 0, F.lit("small")).otherwise("hot").alias("k"), F.format_string("A%06d", "id").alias("v"))
    got = frames.prefix_lists(df.union(spark.sql("SELECT 'hot', CAST(NULL AS STRING)")), "k", "v", "pool", length=5).collect()
    for k in ("hot", "small"):
        text = ",".join(r.pool for r in sorted(got, key=lambda r: r.prefix) if r.k == k)
        assert text.split(",") == [f"A{i:06d}" for i in range(2500) if (i % 5 == 0) == (k == "small")]
    assert max(len(r.pool.split(",")) for r in got) <= 100


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = frames.top_k(df, "k", [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert rows(top) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', 3)) AS s")
    assert frames.flatten_structs(df).columns == ["a", "s/b", "s/c/d"]
    assert rows(frames.flatten_structs(df)) == [(1, 2, 3)]
    assert frames.lower_names(df).columns == ["a", "s"]


@pytest.mark.parametrize("parts", [1, 8])
def test_keep_one_does_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 1, "w"), ("b", 5, "z")], "k string, n int, v string").repartition(parts)
    assert rows(frames.keep_one(df, "k", [F.asc("n"), F.asc("v")])) == [("a", 1, "w"), ("b", 5, "z")]
