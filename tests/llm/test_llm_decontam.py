from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, odd_documents, sentence, spread

from reviewatlas.llm import decontam

ITEMS = "item_id long, text string"


def plain_distance(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any passage."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, w in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != w)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abcd"), max_size=14))
def test_bit_rows_are_the_edit_distance(pattern, text):
    distance, end = decontam.edit_end(pattern, text)
    assert distance == plain_distance(pattern, text)
    d, a, b = decontam.edit_passage(pattern, text)
    assert (d, b) == (distance, end) and 0 <= a <= b <= len(text)
    assert plain_whole(pattern, text[a:b]) == d


def plain_whole(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    w = list(words)
    for _ in range(edits):
        p, kind = rng.randrange(len(w)), rng.choice("sid")
        if kind == "s":
            w[p] = f"new{rng.randrange(99)}"
        elif kind == "i":
            w.insert(p, f"new{rng.randrange(99)}")
        else:
            del w[p]
    return w


def corpus(rng: random.Random) -> tuple[list[tuple], list[tuple]]:
    items = [(i, sentence(rng, rng.randrange(12, 70), 400)) for i in range(40)]
    rows = odd_documents(rng)
    for k in range(120):
        i, text = rng.choice(items)
        w = text.split()
        middle = edited(rng, w, rng.randrange(int(len(w) * 0.3) + 1))
        rows.append((100 + k, f"{sentence(rng, 30, 400)}. {' '.join(middle).title()}! {sentence(rng, 30, 400)}", "en", "a", 1))
    return items, rows


def test_matches_are_those_of_brute_force(spark, frame):
    items, rows = corpus(random.Random(8))
    got = decontam.matches(spread(frame, rows), frame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = set()
    for doc, text, *_ in rows:
        w = decontam.item_words(text)
        if len(w) < 5000:
            want |= {(doc, i) for i, t in items if plain_distance(t.split(), w) <= int(len(t.split()) * 0.2)}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 50
    texts = {r[0]: decontam.item_words(r[1]) for r in rows}
    for r in got:
        assert plain_whole(dict(items)[r.item_id].split(), texts[r.doc_id][r.start : r.end]) == r.distance <= r.item_words * 0.2


def test_only_clean_rows_stay_whole(spark, frame):
    items, rows = corpus(random.Random(9))
    bad = {r.doc_id for r in decontam.matches(frame(rows, DOCS), frame(items, ITEMS)).collect()}
    kept = decontam.uncontaminated(spread(frame, rows), frame(items, ITEMS)).collect()
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, kept), key=order) == sorted((r for r in rows if r[0] not in bad), key=order)


def test_blocks_of_items_give_the_same(spark, frame, monkeypatch):
    items, rows = corpus(random.Random(10))
    one = decontam.matches(frame(rows, DOCS), frame(items, ITEMS)).select("doc_id", "item_id").collect()
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (2000,))
    assert len(list(decontam.item_blocks(frame(items, ITEMS)))) > 2
    many = decontam.matches(frame(rows, DOCS), frame(items, ITEMS)).select("doc_id", "item_id").collect()
    assert len(set(many) ^ set(one)) <= 0.05 * len(one)


def test_odd_items_and_empty_tables(spark, frame):
    docs = frame(odd_documents(random.Random(1)), DOCS)
    odd = frame([(None, "a b c d e f g h i j"), (1, None), (2, ""), (3, "too short"), (4, "x y z u v w q r s t"), (4, "x y z u v w q r s t")], ITEMS)
    assert decontam.matches(docs, odd).count() == 0
    hit = frame([(1, "o x y z u v w q r s t o", 5)], "doc_id long, text string, item_id long")
    assert [tuple(r)[:5] for r in decontam.matches(hit, odd).collect()] == [(1, 4, 1, 11, 0)]
    assert decontam.matches(docs, frame([], ITEMS)).count() == 0
    assert decontam.uncontaminated(frame([], DOCS), odd).count() == 0


def test_short_items_and_scripts_without_spaces_are_found():
    items = [(1, "Who wrote Hamlet?"), (2, "What is the capital of France?"), (3, "世界上最高的山是什么山"), (4, "eight nine"), (5, "Zebra")]
    find = lambda text: [m[:4] for m in decontam.Matcher(items).find([text])[0]]
    assert find("say: who wrote hamlet, then") == [(1, 1, 4, 0)]
    assert find("who wrote the hamlet") == [] and find("eight then nine") == [] and find("nine eight") == []
    assert find("what is the big capital of france now") == [(2, 0, 7, 1)]
    assert find("x what is capital of france") == [(2, 1, 6, 1)]
    assert find("请问世界上最高的山是什么山呢") == [(3, 2, 13, 0)]
    assert find("a zebra") == [(5, 1, 2, 0)] and find("") == []
    rng = random.Random(12)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 8))]
        text = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        got = decontam.Matcher([(1, " ".join(words))]).find([" ".join(text)])[0]
        assert bool(got) == (plain_distance(words, text) <= int(len(words) * 0.2))
