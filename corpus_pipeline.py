"""A training corpus from raw documents: five stages, each calling one operator of reviewatlas.llm.

Every stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet and read again as
the input of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewatlas.llm import decontam, mixing, passages, quality, simhash
from reviewatlas.llm.common import table, written

#: Columns of documents, as every stage but the last returns them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the frequency limits leave the others' texts.

    Null and empty texts fail the base rules and go; a null id or source is a value like any other. Equal rows share their fate, rows that share
    an id but not the text have each their own. An empty table stays empty; columns beyond those of documents are left out.
    """
    return _documents(quality.cleaned(docs.select(*COLUMNS)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without an id stay.

    The decision is one about a row's id and text: of rows that share an id but not the text each goes with the group of its own text. Rows
    equal in both become one, the least by their other columns. Null and empty texts are near copies of each other. An empty table stays empty.
    """
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    gone = found.where("doc_id <> component_id").select("doc_id", F.col("body").alias("_body")).distinct()
    rest = docs.select(*COLUMNS, F.xxhash64("text").alias("_body")).join(gone, ["doc_id", "_body"], "left_anti")
    named, nameless = rest.where("doc_id is not null"), rest.where("doc_id is null")
    once = named.groupBy("doc_id", "_body").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row"))
    return once.select("doc_id", "_row.*").select(*COLUMNS).union(nameless.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds leave the text; a document without any other word goes.

    Null and empty texts and rows without an id stay as they are. Of rows that share an id but not the text each loses the passages of its own text, that of the
    smaller hash being the earlier one. Equal rows share their fate. An empty table stays empty.
    """
    return _documents(passages.without_repeats(docs.select(*COLUMNS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Null and empty texts hold none and stay, with or without an id; equal rows share their fate. Without
    documents or without items nothing changes."""
    return decontam.uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix; weights are the square roots of the sources' sizes. A null source is a source of its own, null
    ids and texts take part, equal rows get consecutive places, and an empty table stays empty."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Fingerprints, passages and edit distances are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
