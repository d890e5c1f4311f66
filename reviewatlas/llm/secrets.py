"""Secret scans: rules, and two character Markov models compared by their log-likelihood ratio.

One model describes random strings, the other ordinary identifiers; both count which character follows which in labelled
samples. A token that the first explains better by more than a margin is a secret that no rule names. Everything is
column functions: a text is searched in place, and no row meets another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import bounded_sample, let, word_array

#: Fixed patterns of the rules, in the order in which kinds are listed. A run of sixteen or more (of fourteen or more behind the
#: four letters) is what is left of all runs when the short ones are dropped.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
#: Fixed: shortest value of an assignment.
LEAST_VALUE = 12

#: Tokens that the models judge: their characters, how many those are, and the least length.
TOKEN_CHARS, N_CHARS, LEAST_TOKEN = "A-Za-z0-9+/_=-", 67, 16
TOKEN = f"[{TOKEN_CHARS}]{{{LEAST_TOKEN},}}"
#: Log of the odds against a token being random: about one in a million.
MARGIN = math.log(1e6)
#: Documents whose words are the sample of ordinary identifiers.
SAMPLE_DOCS = 2000
#: Characters are told apart up to this code; a sum is cut into parts of so many entries.
CODES, PART = 128, 256

SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"


def _before(sizes: Column) -> Column:
    """For each entry the sum of those before it, in two levels: appending to an array copies it, so arrays stay short."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("sums"))
    step = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["sums"], F.array(acc["total"])).alias("sums"))
    within = lambda part: F.aggregate(part, zero, step, lambda acc: acc["sums"])
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def lifted(parts: Column) -> Column:
        return let(within(F.transform(parts, total)), lambda start: F.flatten(F.transform(parts, lambda p, k: F.transform(within(p), lambda s: s + F.get(start, k)))))

    numbers = lambda s: F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PART).cast("int"))
    return let(sizes, lambda s: F.when(F.size(s) > 0, let(F.transform(numbers(s), lambda k: F.slice(s, k * PART + 1, PART)), lifted)).otherwise(F.array().cast("array<long>")))


def places(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost first and apart, as structs of start, end (outside, in characters) and value."""

    def joined(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        ends = F.zip_with(_before(steps), steps, lambda before, own: before + own)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("value")))

    none = F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)).otherwise(none)


def _spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")).cast(SPAN))


@dataclass(frozen=True)
class Models:
    """For each pair of codes, the earlier one times CODES plus the later, the log of how much likelier it is in random strings."""

    weights: list[float]


def _codes(token: Column) -> Column:
    """The cells of a token's pairs of neighbouring characters, the first one behind code 0."""
    code = F.transform(F.split(token, "", -1), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    return let(F.filter(code, lambda c: c > 0), lambda c: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), c), F.lit(1), F.size(c)), c, lambda a, b: a * CODES + b))


def labelled(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): labelled samples from the words of ``most`` documents, the first in the order of a hash of doc_id.

    Ordinary identifiers are the different words below ``LEAST_TOKEN`` characters, alone and joined in pairs as names in programs and paths
    are; random strings are digests of the same words, in the alphabets that keys come in. Rows without a doc_id or text give none.
    """
    some = bounded_sample(docs.select("doc_id", "text", F.lit(0).alias("all")).where("text is not null"), "all", "doc_id", most)
    word = some.select(F.explode(word_array(F.col("text"))).alias("w")).select(F.regexp_replace("w", f"[^{TOKEN_CHARS}]", "").alias("w"))
    word = word.where(F.length("w").between(2, LEAST_TOKEN - 1)).distinct()
    digest = F.unhex(F.sha2("w", 256))
    key = F.base64(digest)
    other = F.reverse(F.lower("w"))
    plain = [F.col("w"), *[F.concat("w", F.lit(mark), other) for mark in ("_", "-", "/")], F.concat(F.lower("w"), F.initcap(other)), F.upper(F.concat("w", F.lit("_"), other))]
    random = [F.sha2("w", 256), key, F.translate(key, "+/=", "-_"), F.upper(F.regexp_replace(key, "[+/=]", "")), F.lower(F.regexp_replace(key, "[+/=]", ""))]
    return word.select(F.explode(F.array(*plain)).alias("token"), F.lit(False).alias("random")).union(word.select(F.explode(F.array(*random)), F.lit(True)))


def fit(samples: DataFrame) -> Models:
    """Models from labelled samples (token, random). Counts start at one; only they, a few thousand whatever the sample, reach the driver.

    Null tokens and labels count for nothing; without samples all weights are zero and no token is a secret.
    """
    cells = samples.where("token is not null and random is not null").select("random", F.explode(_codes(F.col("token"))).alias("cell"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in cells.groupBy("random", "cell").count().collect():
        counts[r["random"]][r["cell"]] = r["count"]

    def logs(of: dict[int, int]) -> list[float]:
        rows = [sum(of.get(a * CODES + b, 0) for b in range(CODES)) for a in range(CODES)]
        return [math.log((of.get(k, 0) + 1) / (rows[k // CODES] + N_CHARS)) for k in range(CODES * CODES)]

    return Models([round(a - b, 6) for a, b in zip(logs(counts[True]), logs(counts[False]), strict=True)])


def ratio(token: Column, models: Models) -> Column:
    """How much better the model of random strings explains a token, as the log of a ratio; 0 for an empty token."""
    # one literal that the optimizer folds into an array
    weights = F.split(F.lit(",".join(map(repr, models.weights))), ",").cast("array<double>")
    return let(weights, lambda w: F.aggregate(_codes(token), F.lit(0.0), lambda a, cell: a + F.get(w, cell)))


def scan(docs: DataFrame, models: Models, margin: float = MARGIN) -> DataFrame:
    """(doc_id, base, spans, n_assign, n_access, n_hex, n_markov): the secrets of every text.

    ``base`` has the spans of the rules, ``spans`` those and, as kind markov, the tokens of ``TOKEN`` that the models find random by
    ``margin`` or more, unless a rule's span or the value of an assignment is that very token. A span has start, end (outside, in
    characters), kind and its rank; they are in the order of start and rank.

    One row per row, repeated ones included. A null or empty text has no spans; a null doc_id stays null. Other columns are ignored,
    whatever their names; an empty table gives no rows. Work and memory for a text are in proportion to its length.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    value = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2))
    found = rows.select(
        "doc_id", F.filter(places(F.col("text"), ASSIGN), lambda m: value(m) >= LEAST_VALUE).alias("assign"),
        places(F.col("text"), ACCESS).alias("access"), places(F.col("text"), HEX).alias("hex"), places(F.col("text"), TOKEN).alias("token"),
    )
    # a place as one number, so that sets of them are hashed; texts have less than 2^31 characters
    place = lambda start, end: start * (1 << 31) + end
    each = lambda c: F.transform(c, lambda m: place(m["start"], m["end"]))
    ruled = F.concat(F.transform("assign", lambda m: place(m["end"] - value(m), m["end"])), each("access"), each("hex"))
    random = F.filter("token", lambda t: ratio(t["value"], models) >= margin)
    added = F.when(F.size("token") > 0, F.array_except(each(random), ruled)).otherwise(F.array().cast("array<long>"))
    spans = F.transform(added, lambda k: F.struct(F.shiftright(k, 31).alias("start"), k.bitwiseAND((1 << 31) - 1).alias("end")))
    base = F.concat(*[_spans(F.col(kind), rank, kind) for rank, kind in enumerate(KINDS)])
    judged = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(base).alias("base"), _spans(spans, len(KINDS), "markov").alias("markov"))
    return judged.select("doc_id", "base", F.array_sort(F.concat("base", "markov")).alias("spans"), *[f"n_{k}" for k in KINDS], F.size("markov").cast("long").alias("n_markov"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
