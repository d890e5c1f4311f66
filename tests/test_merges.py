"""Merges: policies, repeats, and rows that must not move."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import linkage, tags as T, upsert as up

DDL = "k string, a string, b string"
OLD = [("1", "old", "x"), ("2", None, "y"), ("3", "Unknown", None)]
NEW = [("1", None, "n1"), ("2", "new", "n2"), ("4", "ins", "n4"), ("4", "ins", "n3")]


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        ("overwrite", [("1", None, "n1"), ("2", "new", "n2"), ("3", "Unknown", None), ("4", "ins", "n4")]),
        ("fill", [("1", "old", "n1"), ("2", "new", "n2"), ("3", "Unknown", None), ("4", "ins", "n4")]),
        ("keep", [("1", "old", "x"), ("2", None, "y"), ("3", "Unknown", None), ("4", "ins", "n4")]),
        ({"a": up.guarded([None, "Unknown"])}, [("1", "old", "x"), ("2", "new", "y"), ("3", "Unknown", None), ("4", "ins", "n4")]),
    ],
)
def test_policies_and_repeat(frame, policy, want):
    old, new = frame(OLD, DDL), frame(NEW, DDL)
    once = up.upsert(old, new, ["k"], policy)
    assert rows(once) == want
    assert rows(up.upsert(once, new, ["k"], policy)) == want


def test_upsert_options(frame):
    old, new = frame(OLD, DDL), frame(NEW, DDL)
    assert rows(up.upsert(old, new, ["k"], insert_new=False), "k") == [("1",), ("2",), ("3",)]
    only = up.upsert(old, new, ["k"], "overwrite", only_if=lambda o: o["a"].isNull())
    assert rows(only) == [("1", "old", "x"), ("2", "new", "n2"), ("3", "Unknown", None), ("4", "ins", "n4")]
    with pytest.raises(ValueError):
        up.upsert(old, new, ["k"], "other")


def test_insert_missing_repeats(frame):
    old, new = frame(OLD, DDL), frame(NEW, DDL)
    once = up.insert_missing(old, new, ["k"])
    assert rows(once, "k") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(up.insert_missing(once, new, ["k"])) == rows(once)


def test_replace_children_leaves_others(frame):
    old = frame([("r1", "t1"), ("r1", "t2"), ("r2", "t3")], "r string, t string")
    new = frame([("r1", "n")], "r string, t string")
    assert rows(up.replace_children(old, new, "r")) == [("r1", "n"), ("r2", "t3")]


def test_advance_queue(frame):
    queue = frame([("q1", "A", "IN_PROGRESS", None), ("q2", "B", "IN_PROGRESS", "n"), ("q3", "A", "COMPLETED", "done")], "request_id string, asin string, status string, note string")
    out = up.advance_queue(queue, frame([("A", "P"), ("B", None)], "asin string, parent string"))
    assert rows(out, "request_id", "status", "note") == [
        ("q1", "COMPLETED", " [Found Parent: P]"), ("q2", "FAILED", "n [Parent Not Found]"), ("q3", "COMPLETED", "done")
    ]


def test_move_key_drops_emptied_family(frame):
    products = frame([("c1", "A"), ("c2", "B")], "asin string, parent_asin string")
    reviews = frame([("r1", "A")], "review_id string, parent_asin string")
    parents = frame([("A", "t")], "parent_asin string, title string")
    p, r, h = up.move_key(products, reviews, parents, frame([("A", "N")], "old string, new string"))
    assert (rows(p), rows(r), rows(h)) == ([("c1", "N"), ("c2", "B")], [("r1", "N")], [("N", "t")])


def test_link_reviews(frame):
    raw = frame([("r1", "S", "c1"), ("r2", "S", None), ("r2", "S", "c9"), ("r3", "S", "c1")], "review_id string, parent_asin string, child_asin string")
    stored = frame([("r3",)], "review_id string")
    products, parents = frame([("c1", "P")], "asin string, parent_asin string"), frame([("P",)], "parent_asin string")
    fresh, heads = linkage.link_reviews(raw, stored, products, parents)
    assert rows(fresh) == [("r1", "P", "c1"), ("r2", "S", "c9")]
    assert rows(heads, "parent_asin", "title", "verification_status") == [("S", "Recovered Product: S", "UNCERTAIN")]


def test_collapse_last_equals_one_by_one(frame):
    df = frame([("P", "a", None, 1), ("P", None, "x", 2), ("P", "b", None, 3)], "k string, u string, v string, n int")
    assert rows(linkage.collapse_last(df, ["k"], "n")) == [("P", "b", "x")]


def test_ghost_parents(frame):
    df = frame([("c2", "G", "t2"), ("c1", "G", "t1"), ("P", "P", "p")], "asin string, parent_asin string, title string")
    assert rows(linkage.ghost_parents(df)) == [("G", "G", "t1", "AUTO_GENERATED_PARENT")]


def test_responses(frame):
    lines = frame([
        ('{"response": {"candidates": [{"content": {"parts": [{"text": "```json\\n[{\\"id\\": \\"r1\\", \\"c\\": \\"Design\\", \\"a\\": \\"color\\", \\"s\\": \\"Pos\\", \\"q\\": \\"nice\\"}, {\\"id\\": \\"zz\\", \\"s\\": \\"Neg\\"}]\\n```"}]}}]}}',),
        ('{"error": 1}',), ("not json",), ('{"response": {"candidates": [{"content": {"parts": [{"text": "oops"}]}}]}}',),
    ], "value string")
    reviews = frame([("r1", "P", 5.0, "t"), ("r2", "P", 1.0, "bad one"), ("r3", "Q", None, None)], "review_id string, parent_asin string, rating_score double, text string")
    old = frame([("o1", "r1", "P", "Old", "old", "Positive", "q"), ("o2", "r3", "Q", "Old", "old", "Positive", "q")],
                "tag_id string, review_id string, parent_asin string, category string, aspect string, sentiment string, quote string")
    items = T.tag_items(lines)
    assert rows(items, "id", "s") == [("r1", "Pos"), ("zz", "Neg")]
    out, done = T.ingest_tags(items, reviews, old, reviews.filter("review_id <> 'r3'"))
    assert rows(out, "review_id", "aspect", "sentiment", "quote") == [
        ("r1", "color", "Positive", "nice"), ("r2", "general feedback", "Negative", "bad one"), ("r3", "old", "Positive", "q")
    ]
    assert rows(done) == [("r1",), ("r2",)]


def test_prompt_batches_hold_every_record_once(spark):
    df = spark.range(1234).select(F.format_string("r%05d", "id").alias("k"))
    batches = T.prompt_batches(df, "k", F.concat("k", F.lit(",")), size=10).collect()
    assert max(b.records for b in batches) <= 10
    got = [k for b in batches for k in b.body.split(",") if k]
    assert sorted(got) == [f"r{i:05d}" for i in range(1234)]


def test_a_new_record_leaves_other_buckets_alone(spark):
    df = spark.range(500).select(F.format_string("r%05d", "id").alias("k"))
    def batches(rows):
        return {(b.bucket, b.batch): b.body for b in T.prompt_batches(rows, "k", F.concat("k", F.lit(",")), size=10, buckets=16).collect()}
    before, after = batches(df), batches(df.union(spark.sql("SELECT 'new'")))
    assert len({k[0] for k in before.keys() | after.keys() if before.get(k) != after.get(k)}) == 1
