"""URL filters: rules by host and path, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Terms of which one is enough, and terms of which several different ones are needed.
STRICT = ("porn", "porno", "xxx", "viagra", "cialis", "casino", "escort", "escorts", "hentai", "malware", "phishing", "warez", "spam", "adult", "gambling")
SOFT = (
    "ads", "affiliate", "bet", "bets", "bonus", "buy", "cheap", "click", "coupon", "crack", "dating", "deal", "deals", "download",
    "farm", "free", "loan", "loans", "lottery", "nude", "offer", "pill", "pills", "poker", "promo", "sex", "sexy", "slots", "tracker",
    "track", "tracking", "win", "winner",
)
#: A term counts where none of these stands next to it.
NEIGHBOURS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: So many different soft terms reject.
SOFT_LIMIT = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.
    Both are empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def vocabulary(strict=STRICT, soft=SOFT) -> dict[str, int]:
    """Weight by term: ``SOFT_LIMIT`` for a strict one, 1 for a soft one. Strict wins."""
    return {t.lower(): 1 for t in soft} | {t.lower(): SOFT_LIMIT for t in strict}


def terms_in(urls: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``urls`` with strict_terms and soft_terms (sorted arrays of the different terms of each kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term, weight in terms.items():
            machine.add_word(term, (len(term), weight, term))
        machine.make_automaton()
        for batch in batches:
            strict, soft = [], []
            for url in batch.column("url").to_pylist():
                low, found = (url or "").lower(), (set(), set())
                for end, (n, weight, term) in machine.iter(low):
                    before, after = low[end - n : end - n + 1] if end >= n else "", low[end + 1 : end + 2]
                    if before not in NEIGHBOURS and after not in NEIGHBOURS:
                        found[weight < SOFT_LIMIT].add(term)
                strict.append(sorted(found[0]))
                soft.append(sorted(found[1]))
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strict, kind), pa.array(soft, kind)], names=[*batch.schema.names, "strict_terms", "soft_terms"])

    return urls.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in urls.schema)}, strict_terms array<string>, soft_terms array<string>")


def judged(pages: DataFrame, rules=RULES, terms: dict[str, int] | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, strict_terms, soft_terms) of every row.

    A rule that fits decides, the longest first; else a url with a strict term, or with SOFT_LIMIT different soft terms, is blocked and any other
    allowed. A null url has no host, path or term and is allowed. Repeated rows repeat, ids may be null, other columns are ignored, an empty table gives none.
    """
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    host, path = host_and_path(F.col("url"))
    found = terms_in(urls, terms or vocabulary()).withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= SOFT_LIMIT)
    verdict = F.coalesce(by_rule, F.when(bad, "block").otherwise("allow"))
    return found.withColumns({"rule": rule, "verdict": verdict}).select("page_id", "url", "host", "path", "rule", "verdict", "strict_terms", "soft_terms")
