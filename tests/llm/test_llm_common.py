from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

from reviewatlas.llm import common


@pytest.mark.parametrize("most", [1, 40, 5000])
def test_bounded_sample_is_full_and_bounded(spark, frame, most):
    rows = [(i, "big") for i in range(3000)] + [(i, "small") for i in range(30)] + [(None, "big"), (7, None)]
    got = common.bounded_sample(frame(rows, "key long, kind string").repartition(4), "kind", "key", most).collect()
    assert Counter(r.kind for r in got) == {"big": min(most, 3000), "small": min(most, 30)}
    assert common.bounded_sample(frame([], "key long, kind string"), "kind", "key", most).count() == 0


def test_words_are_cut_at_the_six_characters():
    text = "a\u00a0b\tc\nd\x0be\x0cf\rg h\u2003i\x1cj"
    assert [w.decode() for w in common.words(text)] == ["a\u00a0b", "c", "d", "e", "f", "g", "h\u2003i\x1cj"]
    assert common.words(None) == common.words("") == []


def test_word_arrays_agree(spark, frame):
    text = "a\u00a0b\tc\nd\x0be\x0cf\rg  h\u2003i\x1cj "
    row = frame([(text,), (None,)], "text string").select(common.word_array(common.F.col("text")).alias("w")).collect()
    assert [list(r.w) for r in row] == [[w.decode() for w in common.words(text)], []]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 100, 3, 3)] + [None])], names=["text"])
    parts = [p.column("text").to_pylist() for p in common.slices(batch, "text", 6)]
    assert [x for p in parts for x in p] == batch.column("text").to_pylist() and len(parts) == 3
