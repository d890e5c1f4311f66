from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from llm_cases import DOCS, odd_documents, sentence, spread

from reviewatlas.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def normal(line: str) -> tuple:
    return tuple(WORD.findall(re.sub("[0-9]", "0", line.lower())))


def plain_verdicts(rows: list[tuple], min_docs: int, percent: float, most: int) -> list[tuple]:
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line) and len(normal(line)) <= most:
                holders[host, normal(line)].add(text)
    above = {k for k, v in holders.items() if len(v) >= min_docs and 100 * len(v) >= percent * len(hosts[k[0]])}
    out = []
    for doc, text, _, host, _ in rows:
        n, chars, symbols, dup, rep = plain_counts(text)
        lost = sum(len(normal(x)) for x in (text or "").split("\n") if (host, normal(x)) in above)
        failed = n < 50 or 100 * rep > 50 * n
        depleted = lost > 0 and (n - lost < 30 or 100 * (n - lost) < 30 * n)
        out.append((doc, n, chars, symbols, dup, rep, failed, not failed and not depleted, lost))
    return out


MENU = [f"menu{i} one{i} two{i} three{i} four{i} five{i}" for i in range(10)]


def corpus(rng: random.Random) -> list[tuple]:
    rows = odd_documents(rng)
    banner, footer = "Sign up NOW, 24 hours", "copyright 2024 | all rights"
    for i in range(60):
        body = "\n".join(sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5)))
        host = rng.choice(["a", "a", "b", None])
        rows.append((1000 + i, "\n".join([*rng.sample(MENU, 6), banner if i % 2 else banner.replace("24", "17"), body, footer if i % 3 else "", body.split("\n")[0]]), "en", host, 1))
    rows += [(2000, f"{banner}\n{footer}\n" * 8, "en", "a", 1), (2001, "\n".join([*MENU, sentence(rng, 10)]), "en", "a", 1), (2002, "of the of the " * 40, "en", "a", 1)]
    return rows


COLUMNS = ["doc_id", *quality.COUNTS, "base_failed", "kept", "removed_words"]


def test_verdicts_match_the_plain_rules(spark, frame):
    rows = corpus(random.Random(1))
    got = quality.verdicts(spread(frame, rows), min_docs=5).select(*COLUMNS).collect()
    order = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    want = plain_verdicts(rows, 5, 0.2, 30)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert any(r[-1] for r in want) and any(not r[-3] and not r[-2] for r in want)


def test_copies_of_a_text_are_one_document(spark, frame):
    text = "\n".join(sentence(random.Random(i), 20) for i in range(5))
    got = quality.verdicts(frame([(i, text, "en", "a", 1) for i in range(50)], DOCS)).select("kept").distinct().collect()
    assert [r.kept for r in got] == [True]


def test_cleaned_drops_lines_and_rejected_rows(spark, frame):
    rows = corpus(random.Random(1))
    got = quality.cleaned(spread(frame, rows), min_docs=5)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [r[0] for r in plain_verdicts(rows, 5, 0.2, 30) if r[-2]]
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(kept)
    assert not any("hours" in r.text for r in found if r.source == "a" and r.doc_id is not None and r.doc_id >= 1000)


def test_a_filter_on_a_verdict_stays_cheap(spark, frame):
    long = [(i, sentence(random.Random(i), 20_000), "en", "a", 1) for i in range(4)]
    assert quality.verdicts(frame(long, DOCS)).where("n_repeat_words < 10 AND kept").count() == 4


def test_clashing_columns_and_an_empty_table(spark, frame):
    extra = frame([(1, "x " * 60, "a", 3, True, 5)], "doc_id long, text string, source string, n_words long, kept boolean, body long")
    assert [r.n_words for r in quality.verdicts(extra).collect()] == [60]
    assert quality.cleaned(extra).count() == 0
    assert quality.verdicts(frame([], DOCS)).count() == 0


def test_long_lines_are_counted_and_removed(spark, frame):
    rng = random.Random(4)
    for n in (31, 45, 60):
        notice = sentence(rng, n)
        rows = [(i, f"{sentence(rng, 40)}\n{notice}\n{sentence(rng, 40)}", "en", "a", 1) for i in range(25)]
        rows.append((100, f"{notice}\n{sentence(rng, 20)}", "en", "a", 1))
        got = {r.doc_id: (r.removed_words, r.kept) for r in quality.verdicts(spread(frame, rows)).collect()}
        assert got == {i: (n, True) for i in range(25)} | {100: (n, False)}
        assert not any(notice in r.text for r in quality.cleaned(spread(frame, rows)).collect())


def test_the_twin_counts_long_lines(spark, frame, tmp_path):
    import duckdb

    from reviewatlas.llm import oracles, queries

    rng = random.Random(6)
    notice = sentence(rng, 45)
    rows = [(i, f"{sentence(rng, 40)}\n{notice}\n{sentence(rng, 40)}", "en", "a", 1) for i in range(25)] + [(100, f"{notice}\n{sentence(rng, 20)}", "en", "a", 1)]
    frame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(oracles.quality_sql())
    names = [d[0] for d in cur.description]
    got = queries.op4_quality_rules(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
    assert {r["doc_id"]: r["removed_words"] for r in got} == {r[0]: 45 for r in rows}
