from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from llm_cases import DOCS, odd_documents, spread

from reviewatlas.llm import mixing


def plain_schedule(shares: list[tuple[str, int]]) -> list[int]:
    h = sum(s for _, s in shares)
    done, picks = [0] * len(shares), []
    for t in range(h):
        ready = [(-(-(d + 1) * h // s), j) for j, (d, (_, s)) in enumerate(zip(done, shares, strict=True)) if d * h // s <= t]
        j = min(ready)[1]
        done[j] += 1
        picks.append(j)
    return picks


@pytest.mark.parametrize("shares", [[("=a", 1)], [("=a", 3), ("=b", 2), ("=c", 1)], [("=a", 37), ("=b", 33), ("=c", 20), ("=d", 9), ("=e", 1)]])
def test_period_is_pfair(spark, frame, shares):
    rows = mixing.schedule(frame([(n, 10, s) for n, s in shares], "_name string, n_docs long, share long")).collect()
    slots = {r["_name"]: r.slots for r in rows}
    h = sum(s for _, s in shares)
    assert sorted(x for v in slots.values() for x in v) == list(range(h))
    for name, share in shares:
        for k, slot in enumerate(slots[name]):
            assert k * h // share <= slot < -(-(k + 1) * h // share)
    picks = plain_schedule(shares)
    assert slots == {n: [t for t, p in enumerate(picks) if p == j] for j, (n, _) in enumerate(shares)}


def corpus() -> list[tuple]:
    rng = random.Random(3)
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{rng.randrange(7)}", 1) for i in range(900)]
    return rows + odd_documents(rng)


@pytest.mark.parametrize("targets", [None, {"hot": 0.5, "s1": 0.25, "a": 0.05}])
def test_prefixes_hold_the_targets_and_no_row_is_lost(spark, frame, targets):
    rows = corpus()
    docs = spread(frame, rows)
    got = mixing.mixed(docs, targets, block=4).collect()
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(rows, key=order)
    share = {r["_name"]: r.share for r in mixing.shares(docs, targets).collect()}
    h = sum(share.values())
    name = lambda r: "" if r.source is None else "=" + r.source
    by_slot = {r.mix_slot: name(r) for r in got}
    done = Counter()
    on_target = {r.mix_slot for r in got if r.mix_on_target}
    assert on_target == set(range(len(on_target)))
    for t in range(len(on_target)):
        done[by_slot[t]] += 1
        assert all(abs(done[s] - (t + 1) * share[s] / h) < 1 for s in share)
    blocks = defaultdict(list)
    for r in got:
        blocks[name(r), r.mix_block].append(r.mix_place)
        assert len({name(x) for x in got if x.mix_slot == r.mix_slot}) == 1 if r.mix_slot < 3 else True
    for (source, block), places in blocks.items():
        assert sorted(places) == list(range(len(places)))
        assert len(places) == 4 or (source, block + 1) not in blocks


def test_the_order_does_not_depend_on_the_partitions(spark, frame):
    rows = corpus()[:200]
    a, b = (sorted(mixing.mixed(frame(rows, DOCS).repartition(n)).select("doc_id", "mix_slot", "mix_place").collect()) for n in (1, 7))
    assert a == b


def test_clashing_columns_and_an_empty_table(spark, frame):
    extra = frame([(1, "t", "s", 8, 9, 10)], "doc_id long, text string, source string, share long, period long, mix_slot long")
    row = mixing.mixed(extra).first()
    assert (row.share, row.period, row.mix_slot) == (8, 9, 0)
    assert mixing.mixed(frame([], DOCS)).count() == 0
