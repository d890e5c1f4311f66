"""Whitening against numpy's own eigenvectors and exact sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from reviewatlas.llm import queries, whitening


def covariance(rng, d, rank=None, spread=3.0):
    a = rng.normal(size=(d, rank or d)) * np.exp(rng.uniform(-spread, spread, size=rank or d))
    return a @ a.T


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (7, 7), (20, 20), (64, 64), (9, 4), (30, 1)])
def test_cholesky_and_components(d, rank):
    rng = np.random.default_rng(d)
    v = covariance(rng, d, rank)
    g = whitening.pivoted_cholesky(v)
    assert g.shape == (d, rank) and np.allclose(g @ g.T, v, rtol=1e-10, atol=1e-10 * v.max())
    # rows in pivot order are triangular: row k of some order is zero behind its k-th column
    order = sorted(range(d), key=lambda i: int(np.flatnonzero(np.abs(g[i]) > 0)[-1]))
    assert all(not np.any(g[i, k + 1 :]) for k, i in enumerate(order[:rank]))
    values, u = whitening.eigen(v)
    want = np.linalg.eigvalsh(v)[::-1][:rank]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-11 * v.max())
    assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12)
    assert np.abs(v @ u - u * values).max() < 1e-11 * values[0]


def test_small_eigenvalues_keep_their_digits():
    """Graded matrices, where one-sided Jacobi is better than a tridiagonal method."""
    scale = 10.0 ** -np.arange(6)
    rng = np.random.default_rng(1)
    m = np.eye(6) + 0.1 * rng.normal(size=(6, 6))
    v = (m @ m.T) * np.outer(scale, scale)
    values, u = whitening.eigen(v)
    assert len(values) == 6
    assert np.abs((u / np.sqrt(values)).T @ v @ (u / np.sqrt(values)) - np.eye(6)).max() < 1e-9


def test_rounds_hold_every_pair_once():
    for n in (1, 2, 3, 6, 7):
        pairs = [(int(a), int(b)) for i, j in whitening._rounds(n) for a, b in zip(i, j, strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len({*i.tolist(), *j.tolist()}) == 2 * len(i) for i, j in whitening._rounds(n))


def plain(rows, most=16):
    """{row number: [(component, n, deviation, |whitened|, explained)]} in whole numbers and one piece."""
    lengths = [len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    usual = max(set(lengths), key=lambda k: (lengths.count(k), k), default=0)
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == usual and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    if not n:
        return [], 0
    x = np.array(fit, dtype=float)
    sums = [sum(col) for col in zip(*fit, strict=True)]
    v = np.cov(x.T, bias=True).reshape(usual, usual)
    values, u = np.linalg.eigh(v)
    values, u = values[::-1], u[:, ::-1]
    k = min(most, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    out = []
    for i, row in kept:
        far = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        w = (np.array(row) - np.array(sums) / n) @ u[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, far, abs(w[c]), values[c] / values.sum()) for c in range(k)]
    return out, k


def test_the_query_against_the_plain_version(spark, frame, tmp_path):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0.3 * k, 0.2 + 0.1 * k) for k in range(20)]
    rows = [(k, vec()) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(70)] + [(5, rows[3][1]), (5, rows[3][1]), (None, vec())]
    rows += [(300, None), (301, []), (302, [None] * 20), (303, [float("nan"), *vec()[1:]]), (304, [float("inf"), *vec()[1:]]), (305, [1.0, 2.0])]
    frame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, n double").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    want, k = plain(rows)
    assert k == 16 and len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    for g, w in zip(sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_no_rows_no_spread_low_rank(frame):
    ddl = "vec_id int, embedding array<double>"
    assert whitening.whitened(frame([], ddl)).collect() == []
    assert whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ddl)).collect() == []
    line = whitening.whitened(frame([(k, [k * 1.0, 2.0 * k, 0.0]) for k in range(9)], ddl)).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1.0)
    huge = whitening.whitened(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], ddl)).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and any(r["deviation"] is None for r in huge)


def test_deviations_are_exact_where_long_sums_would_overflow():
    x = np.array([[3_000_000_000, 1], [5, 7]])
    assert whitening.deviations(x, 1, [0, 0]) == [9_000_000_000_000_000_001 if 9_000_000_000_000_000_001 < 1 << 63 else None, 74]
    assert whitening.deviations(x, 2, [0, 0])[0] is None
