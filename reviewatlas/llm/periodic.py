"""Periodic run detection: block convolution with an exact integer transform.

A run is a maximal stretch of words with a smallest period q and at least two periods. At the scale b its words are
cut into blocks of b words; a run with a period between 2b - 1 and 4b - 2 holds a whole block that occurs again q
words later, so all blocks together with the window that follows each find every such run. A block's occurrences in its
window are the zeros of the sum of squared differences, which one convolution gives for all distances. The convolution is
a number-theoretic transform, so a zero is a zero. The distances are seeds: each is extended both ways as far as
words that far apart are identical.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import arrow_map, slices

#: Fixed: a prime with roots of unity of every order up to 2^30, products of residues below 2^64, and a generator.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
#: Shortest run in words.
MIN_LENGTH = 12
#: Values in one transform, unless a single block needs more.
CHUNK = 1 << 18

_P = np.uint64(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


def _below(x: np.ndarray) -> np.ndarray:
    """x - PRIME where that is not negative: the wrapped difference is the larger one otherwise."""
    return np.minimum(x, x - _P)


@cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    out = np.ones(1, dtype=np.uint64)
    step = pow(root, -1, PRIME) if inverse else root
    while len(out) < size // 2:
        out = np.concatenate([out, _reduced(out * np.uint64(pow(step, len(out), PRIME)))])
    return out[: max(1, size // 2)]


def transform(x: np.ndarray) -> np.ndarray:
    """Transforms of the columns of x (a power of two rows), rows in bit-reversed order."""
    n, m = x.shape
    h = n // 2
    while h:
        w = _powers(2 * h, False)[None, :, None]
        v = x.reshape(n // (2 * h), 2, h, m)
        a, b = v[:, 0], v[:, 1]
        out = np.empty_like(v)
        out[:, 0] = _below(a + b)
        out[:, 1] = _reduced(_below(a + (_P - b)) * w) if h > 1 else _below(a + (_P - b))
        x = out.reshape(n, m)
        h //= 2
    return x


def restored(x: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``: rows come in bit-reversed order."""
    n, m = x.shape
    h = 1
    while h < n:
        w = _powers(2 * h, True)[None, :, None]
        v = x.reshape(n // (2 * h), 2, h, m)
        a, b = v[:, 0], _reduced(v[:, 1] * w) if h > 1 else v[:, 1]
        out = np.empty_like(v)
        out[:, 0] = _below(a + b)
        out[:, 1] = _below(a + (_P - b))
        x = out.reshape(n, m)
        h *= 2
    return _reduced(x * np.uint64(pow(n, -1, PRIME)))


def squared_differences(blocks: np.ndarray, windows: np.ndarray, shifts: int) -> np.ndarray:
    """For each column the sums of (block[i] - window[i + d])^2 for d below ``shifts``, exact where they are below PRIME."""
    b, m = blocks.shape
    size = 1 << (len(windows) - 1).bit_length()
    turned = np.zeros((size, m), dtype=np.uint64)
    turned[(size - np.arange(b)) % size] = blocks
    padded = np.zeros((size, m), dtype=np.uint64)
    padded[: len(windows)] = windows
    products = restored(_reduced(transform(turned) * transform(padded)))[:shifts]
    squares = np.concatenate([np.zeros((1, m), dtype=np.uint64), np.cumsum(windows * windows, axis=0, dtype=np.uint64)])
    inside = squares[b : b + shifts] - squares[:shifts]
    total = _reduced(inside + (blocks * blocks).sum(axis=0, dtype=np.uint64))
    return _below(total + (_P - _reduced(products * np.uint64(2))))


def _next_same(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How far ahead each word occurs again in its text; the largest number where it does not."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), np.iinfo(np.int64).max)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    out[np.arange(len(ids)) + np.minimum(out, len(ids)) >= end] = np.iinfo(np.int64).max
    return out


def _seeds(ids: np.ndarray, starts: np.ndarray, b: int, low: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks' zero-mismatch occurrences at distances from ``low`` on."""
    # values this small keep every sum below the prime; words that fall together are told apart by the extension
    values = (ids % (isqrt((PRIME - 1) // b))).astype(np.uint64)
    wide = shifts + b - 1
    values = np.concatenate([values, np.zeros(low + wide + b, dtype=np.uint64)])
    found_at, found_by = [], []
    for part in np.array_split(starts, max(1, -(-len(starts) * 4 * b // CHUNK))):
        blocks = values[part[None, :] + np.arange(b)[:, None]]
        windows = values[part[None, :] + low + np.arange(wide)[:, None]]
        by, which = np.nonzero(squared_differences(blocks, windows, shifts) == 0)
        found_at.append(part[which])
        found_by.append(by + low)
    return np.concatenate(found_at), np.concatenate(found_by)


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    at, step, n = 0, 32, min(len(a), len(b))
    while at < n:
        other = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(other):
            return at + int(other[0])
        at, step = at + step, min(step * 2, 1 << 16)
    return n


def _stretches(ids: np.ndarray, d: int, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """The maximal [low, high) of places whose words are identical to those d ahead, around the sorted ``starts``."""
    if len(starts) << 13 > len(ids):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids[:-d] == ids[d:]).view(np.int8), [0]])))
        low, high = edges[::2], edges[1::2]
        at = np.searchsorted(low, starts, "right") - 1
        at = np.unique(at[(at >= 0) & (high[at] > starts)]) if len(low) else at[:0]
        yield from zip(low[at].tolist(), high[at].tolist(), strict=True)
        return
    k = 0
    while k < len(starts):
        i = int(starts[k])
        ahead = _equal_ahead(ids[i:], ids[i + d :])
        if ahead:
            yield i - _equal_ahead(ids[:i][::-1], ids[: i + d][::-1]), i + ahead
        k = max(k + 1, int(np.searchsorted(starts, i + ahead)))


def flat_runs(ids: np.ndarray, end: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period), in the order of start and period, of the runs of texts that stand one after the other.

    ``ids`` are small whole numbers for the words; behind each text stands a number that occurs nowhere else, so no run
    leaves its text. ``end`` has for each place where its text ends. A block with a word that does not come again within its
    window has no occurrence there and is not transformed.
    """
    n = len(ids)
    period: dict[tuple[int, int], int] = {}
    known = np.zeros((0, 2), dtype=np.int64)  # end and period of the runs so far
    cover = np.full(n, -1, dtype=np.int64)  # the longest known run at each place
    longest = int(np.max(end - np.arange(n))) if n else 0
    gap, b = _next_same(ids, end), 2
    gap = np.concatenate([gap, np.full(n % 2, np.iinfo(np.int64).max)]).reshape(-1, 2).max(axis=1)
    while b == 2 or 2 * b - 1 <= longest // 2:
        # the shortest run gives periods up to six at least six places, so blocks of two serve them
        low, shifts = (1, 6) if b == 2 else (2 * b - 1, 2 * b)
        starts = np.flatnonzero(gap <= low + shifts - 1) * b
        if len(starts):
            at, by = _seeds(ids, starts, b, low, shifts)
            inside = at + by + b <= end[at]
            run = cover[at]
            # inside a known run a multiple of its period only finds it again
            old = (run >= 0) & (known[run, 0] >= at + by + b) & (by % np.maximum(known[run, 1], 1) == 0) if len(known) else np.zeros(len(at), dtype=bool)
            at, by = at[inside & ~old], by[inside & ~old]
            order = np.lexsort((at, by))
            at, by = at[order], by[order]
            cuts = np.flatnonzero(np.diff(by, prepend=-1))
            new = []
            for i, j in pairwise([*cuts.tolist(), len(by)]):
                d = int(by[i])
                for lo, hi in _stretches(ids, d, at[i:j]):
                    if hi + d - lo >= max(min_length, 2 * d) and (lo, hi + d) not in period:
                        period[lo, hi + d] = d
                        new.append((lo, hi + d, d))
            for k, (lo, hi, _) in sorted(enumerate(new, len(known)), key=lambda r: r[1][1] - r[1][0]):
                cover[lo:hi] = k
            known = np.concatenate([known, np.array([(hi, d) for _, hi, d in new], dtype=np.int64).reshape(-1, 2)])
        b *= 2
        gap = np.concatenate([gap, np.full(len(gap) % 2, np.iinfo(np.int64).max)]).reshape(-1, 2).max(axis=1)
    out = np.array([(lo, hi - lo, d) for (lo, hi), d in period.items()], dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class _Numbers(dict):
    """Whole numbers for words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each text, given as words."""
    numbers = _Numbers()
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    stop = np.cumsum(sizes)
    ids = np.full(int(stop[-1]) if len(stop) else 0, -1, dtype=np.int64)
    for t, after in zip(texts, stop.tolist(), strict=True):
        ids[after - 1 - len(t) : after - 1] = np.fromiter(map(numbers.__getitem__, t), dtype=np.int64, count=len(t))
    ids[stop - 1] = len(numbers) + np.arange(len(texts))
    found = flat_runs(ids, np.repeat(stop - 1, sizes), min_length)
    begin = stop - sizes
    cut = np.searchsorted(found[:, 0], np.concatenate([begin, stop[-1:]]))
    return [found[cut[k] : cut[k + 1]] - np.array([begin[k], 0, 0]) for k in range(len(texts))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text, and the text without its repeats.

    A run has the number of its first word, its length in words and its smallest period q; the length is at least ``min_length`` and
    2q, and no neighbouring word keeps the period. ``runs`` is in the order of start and period. ``collapsed`` has the words, joined by
    one space, without those that some run holds behind its first q words. ``min_length`` is 12 or more: shorter runs of small periods
    need not hold a whole block.

    One row per row: repeated rows and ids are judged one by one. A null, empty or blank text has no words and no runs, and
    its collapsed text is empty. A null doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"min_length is {MIN_LENGTH} or more")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            texts = [t.split() if t else [] for t in part.column("text").to_pylist()]
            found = text_runs(texts, min_length)
            after = []
            for t, runs in zip(texts, found, strict=True):
                for start, length, q in runs.tolist():
                    t[start + q : start + length] = [None] * (length - q)
                after.append(b" ".join(w for w in t if w is not None) if len(runs) else b" ".join(t))
            flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
            cuts = np.cumsum([0, *(len(r) for r in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists, pa.array(after, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, SCHEMA)
