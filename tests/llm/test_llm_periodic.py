"""Runs of repeated words against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, odd_documents, spread

from reviewatlas.llm import periodic, queries


def plain_runs(w: list, least: int = periodic.MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in best.items())


def found(*texts: list) -> list[list[tuple]]:
    return [[(s, n, q) for s, n, q in r.tolist()] for r in periodic.text_runs([[str(x).encode() for x in t] for t in texts])]


def by_start_and_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def test_the_prime_has_its_roots():
    p = periodic.PRIME
    assert all(p % k for k in range(2, 60_000)) and (p - 1) % 2**30 == 0
    assert pow(periodic.GENERATOR, (p - 1) // 2, p) == p - 1 and pow(periodic.GENERATOR, (p - 1) // 3, p) != 1


@pytest.mark.parametrize("size", [1, 2, 8, 64, 1024])
def test_the_transform_comes_back(size):
    x = np.random.default_rng(size).integers(0, periodic.PRIME, (size, 3), dtype=np.uint64)
    assert (periodic.restored(periodic.transform(x)) == x).all()


def test_squared_differences_are_exact():
    rng = np.random.default_rng(7)
    for b, shifts in ((2, 6), (4, 8), (64, 128)):
        top = int((periodic.PRIME / b) ** 0.5)
        blocks, windows = rng.integers(0, top, (b, 5), dtype=np.uint64), rng.integers(0, top, (shifts + b - 1, 5), dtype=np.uint64)
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[:, m], windows[d : d + b, m], strict=True)) for m in range(5)] for d in range(shifts)]
        assert periodic.squared_differences(blocks, windows, shifts).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=4))
def test_few_words(texts):
    assert found(*texts) == [by_start_and_period(plain_runs(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=25), st.integers(1, 9)), min_size=1, max_size=6))
def test_repeated_pieces(pieces):
    text = [x for piece, times in pieces for x in piece * times]
    assert found(text) == [by_start_and_period(plain_runs(text))]


def test_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for t in (b, [5] * 700, [0, 1] * 300 + [2] + [0, 1] * 300, ([0] * 40 + [1]) * 12, [*range(300), *range(300)]):
        assert found(t) == [by_start_and_period(plain_runs(t))]


def test_long_texts_of_many_scales():
    rng = random.Random(3)
    unit = [rng.randrange(5000) for _ in range(9001)]
    text = [-1, *unit, *unit, *unit[:77], -2]
    long = [7] * 200_000
    (one, two) = found(text, long)
    assert (1, 2 * 9001 + 77, 9001) in one and two == [(0, 200_000, 1)]
    assert periodic.text_runs([]) == [] and found([]) == [[]]


def test_a_fresh_copy_behind_does_not_make_a_run():
    text = list(range(40))
    assert found(text, text, text) == [[], [], []]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_query(doc_id, text) -> tuple:
    w = text.encode().split() if text else []
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = by_start_and_period(plain_runs(w))
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(((-m, s, q) for s, m, q in runs), default=None)
    said = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop).decode()
    return (doc_id, len(runs), *said, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept))


def test_the_query_against_the_plain_version(spark, frame, tmp_path):
    rng = random.Random(5)
    rows = [r for r in odd_documents(rng) if r[1] is None or len(r[1]) < 50_000]
    for k in range(100, 400):
        words = [f"w{rng.randrange(rng.choice((2, 40, 900)))}" for _ in range(rng.randrange(1, 160))]
        rows.append((k, rng.choice((" ", "\n", " \t ")).join(words * rng.choice((1, 1, 2, 3))), "en", "a", 1))
    rows += [(12, "漢 é " * 10, None, None, 0), (12, "漢 é " * 10, None, None, 0)]
    spread(frame, rows, DOCS).withColumnRenamed("n_chars", "runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_query(r[0], r[1]) for r in rows), key=str)
    assert {r["n_runs"] for r in got} - {0}


def test_real_outputs_and_empty_tables(frame):
    rows = [(1, "a " + "x y z " * 5 + "b"), (None, "q " * 12), (2, None), (3, " \n")]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(frame(rows, "doc_id int, text string")).collect()}
    assert got[1]["collapsed"] == "a x y z b" and [tuple(r) for r in got[1]["runs"]] == [(1, 15, 3)] and got[1]["n_words"] == 17
    assert got[None]["collapsed"] == "q" and got[2]["runs"] == [] == got[3]["runs"] and got[2]["collapsed"] == "" == got[3]["collapsed"]
    assert periodic.periodic_runs(frame([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="12"):
        periodic.periodic_runs(frame(rows, "doc_id int, text string"), 5)
