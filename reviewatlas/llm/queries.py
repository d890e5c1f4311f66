"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewatlas.llm import compression, decontam, extract, langid, mixing, oracles, passages, periodic, quality, secrets, simhash, urls, warc, whitening
from reviewatlas.llm.common import let, table, word_array


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "mix_on_target")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "removed_words")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.main_text(pages, extract.fit(pages))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def _remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(_remainder(3) != 1).select("text", "lang", F.col("doc_id").alias("key"))
    found = langid.predict(docs, langid.fit(learn))
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = compression.score(docs, compression.fit(docs, labels.where(_remainder(5) != 0)))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _looped(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of the documents with its words from one on repeating the first of them, others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def words_of(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    return F.when(h % 10 == 0, let(word_array(text), words_of)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.less") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(secrets.labelled(docs)))
    base = F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base, secrets.listed(F.col("spans")).alias("spans"), "n_markov")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_warc": op2_warc,
        "op3_mixing": op3_mixing,
        "op4_quality_rules": op4_quality_rules,
        "op5_html_extraction": op5_html_extraction,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_simhash": op7_simhash,
        "op8_language": op8_language,
        "op9_url_filter": op9_url_filter,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_secret_scan": op12_secret_scan,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": oracles.warc_sql(), "op4_quality_rules": oracles.quality_sql(), "op9_url_filter": oracles.url_sql()}
