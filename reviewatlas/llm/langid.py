"""Language identification by words first, shorter and shorter n-grams for words never seen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewatlas.llm.common import bounded_sample, slices

#: Fitted on so many documents of each language, the first by a hash of the id; so many words and n-grams of each
#: length are kept per language, the most frequent first: caps on the size of the model, which every task holds.
SAMPLE_DOCS, KEPT_WORDS, KEPT_GRAMS = 2000, 30_000, 10_000
#: Longest n-gram; the count that a language without a word or n-gram is given.
LONGEST, SMOOTHING = 4, 0.1
UNKNOWN = "und"
#: One rule for learning and prediction: a letter, and the letters and combining marks that follow.
WORD = r"\p{L}[\p{L}\p{M}]*"
LETTERS = regex.compile(WORD)


def spark_words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@dataclass
class Model:
    """Log frequencies: a row of ``scores`` for each word (``words``) or n-gram (``grams``), a column for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def _kept(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    ranked = counts.withColumn("_at", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("n"), "token")))
    return ranked.where(F.col("_at") <= most).drop("_at")


def fit(labelled: DataFrame, sample: int = SAMPLE_DOCS, kept_words: int = KEPT_WORDS, kept_grams: int = KEPT_GRAMS) -> Model:
    """Learns from (text, lang, key); rows without a text, lang or key are skipped. ``key`` orders the sample."""
    chosen = bounded_sample(labelled.where("text is not null").select("key", "lang", "text"), "lang", "key", sample)
    counts = chosen.select("lang", F.explode(spark_words(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("_"), F.col("token"), F.lit("_"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: marked.substr(i, F.lit(n)))
    every = F.flatten(F.array(*(F.when(F.length(marked) >= n, gram(n)).otherwise(F.array().cast("array<string>")) for n in range(1, LONGEST + 1))))
    grams = counts.select("lang", "n", F.explode(every).alias("token")).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    words_ = _kept(counts, [], kept_words).withColumn("kind", F.lit("word"))
    grams_ = _kept(grams.withColumn("size", F.length("token")), ["size"], kept_grams).drop("size").withColumn("kind", F.lit("gram"))
    found = words_.select("kind", "lang", "token", "n").union(grams_.select("kind", "lang", "token", "n")).collect()

    languages = sorted({r["lang"] for r in found})
    column = {x: i for i, x in enumerate(languages)}
    tables: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for r in sorted(found, key=lambda r: (r["kind"], r["token"])):
        tables[r["kind"] == "gram"].setdefault(r["token"], len(tables[0]) + len(tables[1]))
    n_rows = len(tables[0]) + len(tables[1])
    seen, size = np.zeros((n_rows, max(1, len(languages)))), np.zeros(n_rows, dtype=np.int64)
    for r in found:
        at = tables[r["kind"] == "gram"][r["token"]]
        seen[at, column[r["lang"]]] = r["n"]
        size[at] = len(r["token"]) if r["kind"] == "gram" else 0
    scores = np.zeros_like(seen)
    for k in range(LONGEST + 1):
        own = size == k
        total = seen[own].sum(axis=0, keepdims=True)
        scores[own] = np.log((seen[own] + SMOOTHING) / (total + SMOOTHING * max(1, own.sum())))
    return Model(languages, tables[0], tables[1], scores)


class Scorer:
    """Scores texts with a model; unseen words are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.unseen = model, {}

    def backoff(self, word: str) -> tuple[int, ...]:
        """Rows of the known n-grams of the longest length that has any."""
        marked, get = f"_{word}_", self.model.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            rows = [r for r in map(get, [marked[i : i + n] for i in range(len(marked) - n + 1)]) if r is not None]
            if rows:
                return tuple(rows)
        return ()

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share of the likelihood); ties go to the first language by name."""
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        rows = list(map(self.model.words.get, found))
        known = [r for r in rows if r is not None]
        total = self.model.scores[known].sum(axis=0) if known else np.zeros(len(self.model.languages))
        if len(known) < len(rows):
            places, weights = [], []
            for word, row in zip(found, rows, strict=True):
                if row is None:
                    grams = self.unseen.get(word)
                    if grams is None:
                        if len(self.unseen) >= 1 << 17:
                            self.unseen.clear()
                        grams = self.unseen[word] = self.backoff(word)
                    places += grams
                    weights += [1 / len(grams)] * len(grams) if grams else []
            if places:
                total = total + np.asarray(weights) @ self.model.scores[places]
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the whole text alone.

    A null text, one without a letter, and every text where the model learned no language is ``und`` with score 0. Repeated rows repeat, a null
    doc_id is carried, other columns are ignored, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scorer.predict(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
