from __future__ import annotations

import hashlib
import io
import random

import pytest
import zstandard
from llm_cases import sentence
from pyspark.errors import PySparkException

from reviewatlas.llm import warc
from reviewatlas.session import scratch_path

PAGES = "page_id long, url string, html string"


def pages() -> list[tuple]:
    rng = random.Random(1)
    same, small = sentence(rng, 40), "tiny"
    rows = [(i, f"http://h/{i}", f"<p>{sentence(rng, rng.randrange(400))}</p>") for i in range(60)]
    rows += [(100, "http://h/ a\r\nX: y", same), (101, None, same), (99, "http://é/", same), (99, "http://é/", same), (None, "u", same)]
    rows += [(102, "u", small), (103, "u", small), (104, "u", None), (105, "u", ""), (106, "u", "x\r\n\r\nWARC/1.1\r\n" * 9), (107, "u", "🙂" * 300_000)]
    return rows


def expected(rows: list[tuple]) -> list[tuple]:
    body = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in body:
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in body:
        to = first.get(b) if first.get(b) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


def test_round_trip(spark, frame):
    rows = pages()
    got = warc.round_trip(frame(rows, PAGES).repartition(3)).collect()
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=order) == sorted(expected(rows), key=order)
    html = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == (html[r.page_id] or "")
    assert {r.url for r in got if r.page_id == 100} == {"http://h/%20a%0D%0AX:%20y"}


def test_archives_are_plain_zstandard_with_a_leading_dictionary(spark, frame):
    folder = scratch_path(spark, "archives")
    made = warc.write_archives(frame(pages() * 3, PAGES).repartition(2), folder, file_bytes=20_000)
    assert made.agg({"records": "sum"}).first()[0] == 3 * len(pages()) and made.count() > 2
    assert sorted(r.path.rpartition("/")[2] for r in warc.archives_below(spark, folder).collect()) == sorted(r.path.rpartition("/")[2] for r in made.collect())
    path = made.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    found = [warc.parse_record(x) for x in warc.frames(io.BytesIO(data))]
    assert len(found) == next(r.records for r in made.collect() if r.path.endswith(path.rpartition("/")[2]))


def one(**change) -> bytes:
    data = warc.record("response", "urn:page:1", "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z")
    for old, new in change.pop("swap", ()):
        data = data.replace(old, new)
    return data


@pytest.mark.parametrize("swap", [
    [(b"WARC/1.1", b"WARC/9")], [(b"WARC-Date", b"WARC-Dat")], [(b"\r\n\r\nabc", b"\r\n\r\nabcd")], [(b"sha256:", b"md5:")], [(b"abc", b"abd")], [(b"Content-Length: 3", b"Content-Length: 4")],
])
def test_bad_records_are_refused(swap):
    headers, block = warc.parse_record(one())
    assert warc.parse_response(headers, block) == (3, hashlib.sha256(b"abc").hexdigest(), b"abc")
    with pytest.raises(ValueError):
        warc.parse_response(*warc.parse_record(one(swap=swap)))


def test_a_cut_archive_is_refused():
    data = warc.leading_frame(b"x" * 100) + zstandard.ZstdCompressor().compress(one())
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(warc.leading_frame(b"x" * 1000)[:-5])))
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_a_bad_file_ends_the_job(spark, frame, tmp_path):
    bad = tmp_path / "a.warc.zst"
    bad.write_bytes(zstandard.ZstdCompressor().compress(b"no record"))
    with pytest.raises(PySparkException, match="record 0"):
        warc.read_archives(frame([(str(bad),)], "path string")).collect()


def test_empty_table_and_clashing_columns(spark, frame):
    assert warc.round_trip(frame([], PAGES)).count() == 0
    extra = frame([(1, "u", "h", "d", 5)], "page_id int, url string, html string, digest string, refers_to long")
    assert [r.page_id for r in warc.round_trip(extra).collect()] == [1]
