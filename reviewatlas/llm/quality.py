"""Quality rules: counts of each text, and lines that recur in many documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import SPACES, let, word_array, written

#: Fixed: the symbols that count.
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, the first one included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side;
    the flagged positions, sorted, cover three words each, less what the next one covers.
    """
    hashed = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))

    def flagged(ordered: Column) -> Column:
        equal = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: equal(x, i + 1) | equal(x, i - 1)), lambda x: x["i"]))

    covered = F.aggregate(
        let(F.sort_array(hashed), flagged),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-2).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return F.when(F.size(w) > 3, covered).otherwise(F.lit(0).cast("long"))


def _counts(text: Column) -> Column:
    """The counts of one text as a struct; every part of the text is cut once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    of_words = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return let(
        of_words,
        lambda c: F.struct(
            c["n_words"].alias("n_words"),
            F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            of_lines.alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _key(host: str) -> list[Column]:
    return [F.col("doc_id"), F.col(host).alias("host"), F.xxhash64("text").alias("body")]


def _hashed_line(line: Column) -> Column:
    """(line, n): the hash of a normalised line - words in lower case, every digit as 0 - and its words."""
    plain = F.translate(F.lower(line), "123456789", "0" * 9)
    return let(word_array(plain), lambda w: F.struct(F.xxhash64(w).alias("line"), F.size(w).alias("n")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, body, at, line, n): a row for each line with a word. ``body`` hashes the text, so rows that share a doc_id but not the text stay apart."""
    each = F.filter(F.transform(_lines(F.col("text")), _hashed_line), lambda x: x["n"] > 0)
    rows = docs.select(*_key(host), F.posexplode(each).alias("at", "x"))
    return rows.select("doc_id", "host", "body", "at", "x.line", "x.n")


def frequent_lines(lines: DataFrame, docs: DataFrame, host: str = "source", min_docs: int = 20, min_percent: float = 0.2) -> DataFrame:
    """(line, host, n_docs): lines above the limits.

    A line is above them in a host if ``min_docs`` or more documents of the host with different texts hold it, and these are
    ``min_percent`` or more of the host's different texts. Copies of a text count as one document. Lines of every
    length count. Rows without a host form one host.
    """
    counts = lines.groupBy("line", "host").agg(F.count_distinct("body").alias("n_docs"))
    hosts = docs.select(F.col(host).alias("h"), F.xxhash64("text").alias("body")).groupBy("h").agg(F.count_distinct("body").alias("n_host"))
    above = counts.where(F.col("n_docs") >= min_docs).join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return above.where(100 * F.col("n_docs") >= min_percent * F.col("n_host")).select("line", "host", "n_docs")


def verdicts(
    docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_left_words: int = 30, min_left_percent: int = 30, **limits
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, host, body (a hash of the text), the counts n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long), base_failed, removed (hashes of the lines above the limits), removed_words, depleted and kept.

    Lines above the limits (``frequent_lines``) leave the text; a document that loses a line is depleted if fewer than
    ``min_left_words`` words, or less than ``min_left_percent`` of its words, are left. Null and empty texts have no words and fail the base rules; equal rows
    get equal verdicts; an empty table gives none. A null doc_id or host is a value like any other; other columns are ignored.
    """
    lines = written(document_lines(docs, host), "lines")
    above = frequent_lines(lines, docs, host, **limits).select(F.col("line").alias("_line"), F.col("host").alias("_host"))
    hit = lines.join(above, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    once = hit.groupBy("doc_id", "host", "body", "at").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    found = once.groupBy(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("body").alias("_b")).agg(F.collect_set("line").alias("removed"), F.sum("n").alias("_lost"))
    counted = docs.select(*_key(host), _counts(F.coalesce(F.col("text"), F.lit(""))).alias("_c"))
    counted = counted.select("doc_id", "host", "body", *(F.col("_c")[c].alias(c) for c in COUNTS))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("host").eqNullSafe(F.col("_h")) & (F.col("body") == F.col("_b"))
    out = counted.join(found, same, "left").withColumn("removed_words", F.coalesce("_lost", F.lit(0).cast("long"))).drop("_d", "_h", "_b", "_lost")
    remain = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((remain < min_left_words) | (100 * remain < min_left_percent * F.col("n_words")))
    return out.withColumns({"base_failed": failed, "depleted": depleted}).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def cleaned(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """The kept rows of ``docs`` (``verdicts``), all columns as they are but the text, which loses the lines above the limits."""
    judged = written(verdicts(docs, host, **settings).select("doc_id", "host", "body", "removed", "kept"), "verdicts")
    keep = judged.where("kept").dropDuplicates(["doc_id", "host", "body"]).toDF("_d", "_h", "_b", "_removed", "_kept")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col(host).eqNullSafe(F.col("_h")) & (F.xxhash64("text") == F.col("_b"))
    left = F.array_join(F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("_removed"), _hashed_line(x)["line"])), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left)
    return docs.join(keep, same).withColumn("text", text).select(*docs.columns)
