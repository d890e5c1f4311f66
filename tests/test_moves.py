"""Chains, trees and cycles of moves against a plain walk."""

from __future__ import annotations

import random

from conftest import rows

from reviewatlas.operators import moves

DDL = "old string, new string"


def walk(pairs):
    to = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            to[a] = max(b, to.get(a, b))
    ends, cyclic = [], []
    for a in to:
        at, steps = to[a], 1
        while at in to and steps <= len(to):
            at, steps = to[at], steps + 1
        ends.append((a, at, steps)) if at not in to else cyclic.append((a,))
    return sorted(ends), sorted(cyclic)


def test_against_a_walk(frame):
    rng = random.Random(6)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(130)]
    tree = [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 60)] + [("t0", "c050")]
    cycle = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("z", "y"), ("self", "self"), ("to self", "self")]
    odd = [(None, "a"), ("a", None), ("two", "b"), ("two", "c"), ("two", "c")]
    pairs = chain + tree + cycle + odd
    ends, cyclic = moves.resolved(frame(pairs, DDL).repartition(3))
    want = walk(pairs)
    assert (rows(ends), rows(cyclic)) == want
    assert ("c000", "c130", 130) in want[0] and want[1] == [("x1",), ("x2",), ("x3",), ("y",), ("z",)]


def test_no_moves_and_only_cycles(frame):
    ends, cyclic = moves.resolved(frame([], DDL))
    assert rows(ends) == [] == rows(cyclic)
    ends, cyclic = moves.resolved(frame([("a", "b"), ("b", "a")], DDL))
    assert rows(ends) == [] and rows(cyclic) == [("a",), ("b",)]


def test_tables_follow_whole_chains(frame):
    products = frame([("p1", "A"), ("p2", "C"), ("p3", "X")], "asin string, parent_asin string")
    reviews = frame([("r1", "A"), ("r2", "B"), ("r3", "X")], "review_id string, parent_asin string")
    parents = frame([("A", "one"), ("B", "two"), ("X", "three"), ("Y", "four")], "parent_asin string, title string")
    made = moves.move_families(products, reviews, parents, frame([("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X")], DDL))
    assert rows(made[0]) == [("p1", "C"), ("p2", "C"), ("p3", "X")]
    assert rows(made[1]) == [("r1", "C"), ("r2", "C"), ("r3", "X")]
    assert rows(made[2], "parent_asin") == [("C",), ("X",), ("Y",)]
    assert rows(made[3]) == [("X",), ("Y",)]
