from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import DOCS, odd_documents, sentence, spread
from pyspark.sql import functions as F

from reviewatlas.llm import simhash
from reviewatlas.llm.components import connected


def plain_fingerprint(text: str | None, size: int = 3) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: list[tuple[int | None, int]], bits: int) -> list[int | None]:
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "one", "A b", "A b C", "x y z x y z x y z", "É é\x0bÀ\x85q ·", "the of " * 500])
def test_fingerprint_matches_the_plain_rule(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_shingle_hash_is_sparks_own(spark):
    got = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_words_two_bits_apart_share_a_codeword():
    tables, rng = simhash.golay_tables(), random.Random(2)
    for _ in range(300):
        a = rng.randrange(1 << 23)
        b = a ^ 1 << rng.randrange(23) ^ 0
        b ^= 1 << rng.randrange(23)
        one, two = (set(simhash.codewords(np.array([x]), tables)[0].tolist()) for x in (a, b))
        assert one & two and len(one) in (1, 6)


def families(rng: random.Random, n: int) -> list[int]:
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 12))):
            out.append(x if x < 1 << 63 else x - (1 << 64))
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    return sorted(set(out))


@pytest.mark.parametrize(("bits", "pair_limit"), [(2, 64), (2, 1), (1, 1), (1, 64), (0, 64)])
def test_links_give_the_plain_components(spark, frame, bits, pair_limit):
    fps = families(random.Random(bits + pair_limit), 60)
    nodes = frame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    roots = dict(connected(simhash.links(nodes, bits, pair_limit)).collect())
    want = plain_components([(i, f % (1 << 64)) for i, f in enumerate(fps)], bits)
    assert [roots.get(i, i) for i in range(len(fps))] == want


def near_copies(rng: random.Random) -> list[tuple]:
    rows, n = odd_documents(rng), 100
    for _ in range(12):
        w = sentence(rng, 400).split()
        for _ in range(rng.randrange(1, 6)):
            rows.append((n, " ".join(w), "en", "a", 1))
            n += 1
            w = list(w)
            w[rng.randrange(400)] = "Edit"
    return rows


def test_near_duplicates_match_all_pairs(spark, frame):
    rows = near_copies(random.Random(4))
    got = simhash.near_duplicates(spread(frame, rows)).collect()
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = [(d, f, c) for (d, f), c in zip(fps, plain_components(fps, 2), strict=True)]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=order) == sorted(want, key=order)


def test_clashing_columns_and_an_empty_table(spark, frame):
    extra = frame([(1, "a b c d", 5, 6, 7)], "doc_id int, text string, fp int, component_id int, node int")
    assert [tuple(r) for r in simhash.near_duplicates(extra).select("doc_id", "component_id").collect()] == [(1, 1)]
    assert simhash.near_duplicates(frame([], DOCS)).count() == 0
    assert simhash.hex_digits(F.lit(1)) is not None


def test_components_of_chains_and_loops(spark, frame):
    edges = [(i + 1, i) for i in range(100, 160)] + [(5, 5), (None, 3), (3, None), (7, 9), (9, 7), (9, 8)]
    got = dict(connected(frame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 8: 7, 9: 7}
    assert connected(frame([], "a long, b long")).count() == 0
