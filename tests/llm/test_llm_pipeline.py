from __future__ import annotations

import random

import pytest
from llm_cases import DOCS, odd_documents, sentence

import corpus_pipeline
from reviewatlas.llm import queries

SF = "/root/testdata/sf0.001"


def corpus(rng: random.Random) -> tuple[list[tuple], list[tuple], dict[str, set[int]]]:
    """Documents, benchmark items, and what should happen to whom."""
    items = [(i, sentence(rng, 30)) for i in range(5)]
    passage = sentence(rng, 70)
    rows, fate = odd_documents(rng), {"clean": set(), "copies": set(), "leaks": set(), "passage": set(), "junk": set()}

    def add(kind: str, text: str) -> None:
        doc = 100 + sum(map(len, fate.values()))
        fate[kind].add(doc)
        rows.append((doc, text, "en", rng.choice("abc"), len(text)))

    for _ in range(20):
        add("clean", "\n".join(sentence(rng, 40) for _ in range(4)))
    near = sentence(rng, 300).split()
    for k in range(8):
        add("copies", " ".join(near if k < 4 else [*near[:-1], f"last{k}"]))
    for i in range(5):
        add("leaks", f"{sentence(rng, 80)}\n{items[i][1]}\n{sentence(rng, 80)}")
    for _ in range(4):
        add("passage", f"{sentence(rng, 80)}\n{passage}\n{sentence(rng, 80)}")
    add("junk", "buy this " * 60)
    return rows, items, fate


@pytest.fixture
def folder(spark, frame, tmp_path):
    rows, items, fate = corpus(random.Random(5))
    frame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, fate


def test_planted_cases_meet_their_fate(spark, folder):
    path, rows, fate = folder
    got = corpus_pipeline.run(spark, path).collect()
    ids = [r.doc_id for r in got]
    texts, before = {r.doc_id: r.text for r in got}, {r[0]: r[1] for r in rows}
    assert len(ids) == len(set(ids))
    assert fate["clean"] <= set(ids) and all(texts[d] == before[d] for d in fate["clean"])
    assert len(fate["copies"] & set(ids)) == 1 and min(fate["copies"]) in ids
    assert not (fate["leaks"] | fate["junk"]) & set(ids)
    first, *others = sorted(fate["passage"])
    passage = before[first].split("\n")[1]
    assert texts[first] == before[first] and all(passage not in texts[d] and texts[d].split("\n")[0] == before[d].split("\n")[0] for d in others)
    assert None in ids and 5 in ids and not {1, 2, 3, 4} & set(ids)


def test_stages_keep_the_columns_and_only_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mix.select(docs.columns).exceptAll(docs).count() == 0 and mix.count() == docs.count()


def test_an_empty_table_and_extra_columns(spark, frame, tmp_path):
    frame([], DOCS + ", kept boolean, key long").write.parquet(f"{tmp_path}/documents.parquet")
    frame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_twins_agree(spark):
    from compare import check, open_tables

    con = open_tables(SF)
    for name, sql in queries.oracle_sql().items():
        assert check(spark, con, (queries.queries()[name], sql), SF) is None


def test_queries_without_a_twin_give_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_mixing", "op7_simhash", "op8_language", "op10_quality_classifier"):
        assert queries.queries()[name](spark, SF).count() == n


def test_rows_of_an_id_meet_their_own_fate(spark, frame):
    """Ids 1 and 5 share a text, and 5 has another text of its own: that one stays."""
    rng = random.Random(21)
    shared, own = sentence(rng, 120), sentence(rng, 140)
    rows = [(1, shared, "en", "a", 1), (5, shared, "en", "b", 1), (5, own, "en", "b", 1), (5, own, "de", "a", 1), (None, shared, "en", "a", 1), (7, None, "en", "a", 1), (8, "", "en", "a", 1)]
    runs = []
    for parts in (1, 5):
        got = corpus_pipeline.simhash_dedup(spark, frame(rows, DOCS).repartition(parts), SF).collect()
        runs.append(sorted(((r.doc_id, r.text, r.lang) for r in got), key=str))
    want = [(1, shared, "en"), (5, own, "de"), (7, None, "en"), (None, shared, "en")]
    assert runs[0] == runs[1] == sorted(want, key=str)
