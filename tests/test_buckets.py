"""Bucketed tables: same rows as the merges over whole tables, and only touched partitions are read or written."""

from __future__ import annotations

import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import buckets
from reviewatlas.operators import upsert as up

DDL = "k string, a string, b int"
N = 8


def files(path):
    return {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("bucket=")}


@pytest.fixture
def stored(frame, tmp_path):
    old = frame([(f"k{i}", f"v{i}", i) for i in range(300)], DDL)
    path = str(tmp_path / "t")
    buckets.store(old, path, ["k"], N)
    return old, path


def test_a_merge_replaces_its_buckets_only(spark, frame, stored):
    old, path = stored
    before = files(path)
    new = frame([("k7", "seven", None), ("n1", "new", 1), (None, "no key", 2)], DDL)
    want = rows(up.upsert(old, new.dropna(subset=["k"]), ["k"], "fill"))
    only = buckets.merge(spark, path, old.schema, new, ["k"], N, policy="fill")
    assert rows(buckets.read(spark, path, old.schema, ["k"])) == want
    after = files(path)
    assert len(only) == 2 and {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in only}
    # the same delivery again, as after a broken-off merge
    buckets.merge(spark, path, old.schema, new, ["k"], N, policy="fill")
    assert rows(buckets.read(spark, path, old.schema, ["k"])) == want


def test_the_filter_reaches_the_scan(spark, frame, stored):
    old, path = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = buckets.lookup(spark, path, old.schema, frame([("k3",), ("k3",), (None,)], "k string"), ["k"], N)
    assert rows(found) == [("k3", "v3", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) or re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan), plan


def test_parents_that_lose_all_children(spark, frame, tmp_path):
    schema = "p string, c string"
    path = str(tmp_path / "t")
    old = frame([("a", "1"), ("a", "2"), ("b", "3")], schema)
    buckets.store(old, path, ["p"], N)
    buckets.replace(spark, path, old.schema, frame([("b", "4")], schema), "p", frame([("a",), ("b",), (None,)], "p string"), N)
    assert rows(buckets.read(spark, path, old.schema, ["p"])) == [("b", "4")]
    buckets.replace(spark, path, old.schema, frame([], schema), "p", frame([("b",)], "p string"), N)
    assert rows(buckets.read(spark, path, old.schema, ["p"])) == []


def test_rows_move_between_buckets(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    old = frame([(f"r{i}", f"f{i % 40}") for i in range(400)], "r string, f string")
    buckets.store(old, path, ["f"], N)
    moves = frame([("f1", "f39"), ("f2", "new"), ("f2", "a"), ("gone", "f3"), (None, "f4")], "f string, to string")
    buckets.relink(spark, path, old.schema, moves, "f", "to", N)
    want = {f"f{i}": f"f{i}" for i in range(40)} | {"f1": "f39", "f2": "new"}
    assert rows(buckets.read(spark, path, old.schema, ["f"])) == sorted((f"r{i}", want[f"f{i % 40}"]) for i in range(400))


def test_tables_and_deliveries_without_rows(spark, frame, tmp_path):
    path = str(tmp_path / "none")
    schema = frame([], DDL).schema
    assert rows(buckets.read(spark, path, schema, ["k"])) == []
    assert buckets.merge(spark, path, schema, frame([], DDL), ["k"], N) == [] == buckets.touched(frame([(None, "x", 1)], DDL), ["k"], N)
    buckets.merge(spark, path, schema, frame([("x", "1", 1)], DDL), ["k"], N)
    assert rows(buckets.read(spark, path, schema, ["k"])) == [("x", "1", 1)]


def test_of_several_deliveries_the_last_counts(spark, frame, stored):
    old, path = stored
    first, second = frame([("k1", "one", 1), ("k2", "two", 2)], DDL), frame([("k1", "uno", 1)], DDL)
    buckets.merge_all(spark, path, old.schema, [first, second], ["k"], N)
    got = buckets.read(spark, path, old.schema, ["k"]).filter(F.col("k").isin("k1", "k2"))
    assert rows(got) == [("k1", "uno", 1), ("k2", "two", 2)]
