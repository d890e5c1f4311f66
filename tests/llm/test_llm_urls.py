from __future__ import annotations

import re

import pytest
from llm_cases import DOCS  # noqa: F401

from reviewatlas.llm import urls

PAGES = "page_id long, url string"


def plain(url: str | None) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = (url or "").lower()
    hits = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in terms)
    soft = [t for t in urls.SOFT if t not in urls.STRICT]
    return host, path, None, "block" if hits(urls.STRICT) or hits(soft) >= urls.SOFT_LIMIT else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "http://ORG/x", "https://example.org/es/1", "https://x.example.org/es/1", "https://example.org/en/12", "https://example.org/en/2",
    "https://notexample.org/es/", "http://b.com/fr/", "http://b.com/fr", "http://b.com/de/3?x#y", "http://casino.net/", "http://casinos.net/", "http://a-casino-b.net", "http://n.net/free", "http://n.net/free/pills",
    "http://n.net/free/free", "http://n.net/freepills", "http://FREE.bets.net:80/", "http://n.net/?q=win&free#x", "http://é.net/xxx", "http://éxxxé.net/", "x://y://z/a", "http://n.net/a b/c", "http://user@n.net/ads#track", "http://com/de/", "//n.net/spam",
    "http://n.net/" + "a" * 100_000 + "/viagra",
]


def test_every_case_follows_the_plain_rule(spark, frame):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(frame(list(enumerate(URLS)), PAGES).repartition(3)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_terms_are_reported_and_the_vocabulary_is_a_parameter(spark, frame):
    row = urls.judged(frame([(1, "http://n.net/free/win/free/spam")], PAGES)).first()
    assert (row.strict_terms, row.soft_terms) == (["spam"], ["free", "win"])
    assert urls.judged(frame([(1, "http://n.net/free/win")], PAGES), terms={"other": 1}).first().verdict == "allow"


@pytest.mark.parametrize("rows", [[], [(None, None, "h", "r")], [(1, "u", "h", "r"), (1, "u", "h", "r")]])
def test_odd_rows_and_clashing_columns(spark, frame, rows):
    assert urls.judged(frame(rows, "page_id long, url string, host string, rule string")).count() == len(rows)
