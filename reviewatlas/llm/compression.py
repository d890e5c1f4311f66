"""Quality classifier by compression.

Two Zstandard dictionaries, of good and of bad labelled texts, compress each text in pieces. How many bytes more the
bad dictionary needs, per byte of text, is the feature; a logistic curve fitted on labelled texts that the
dictionaries have not seen makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import bounded_sample, slices

#: Fitted on so many documents of each label, the first by a hash of the id, those with more characters left out.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: Two thirds of the sample make the dictionaries, the others the curve.
DICTIONARY_SHARE = 2 / 3
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 112_640, 1024, 3


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts' own end where they are too few to train on."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def feature(self) -> "Difference":
        return Difference(self.good, self.bad)


class Difference:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of text; 0 for an empty text."""

    def __init__(self, good: bytes, bad: bytes):
        def packer(data: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data)) if len(data) >= 8 else zstandard.ZstdCompressor(level=LEVEL)

        self.good, self.bad = packer(good), packer(bad)

    def __call__(self, text: bytes) -> float:
        more = 0
        for piece in pieces(text):
            more += len(self.bad.compress(piece)) - len(self.good.compress(piece))
        return more / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray, share: float = 0.5, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of greatest likelihood by Newton's method, where ``share`` of all have y = 1, whatever their share in the sample."""
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        slope = a.T @ (weight * (p - y)) + ridge * np.array([b[0], 0.0])
        bend = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.diag([1.0, 1e-3])
        b -= np.linalg.solve(bend, slope)
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Learns from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks as good (1) or bad (0); other labels are skipped.

    The sample is drawn from the labels, so its ids, at most 2 * ``sample`` of them, are all that meets the documents; of these, texts that are
    null, empty or of more than ``chars`` characters are left out. Of rows that share an id one text counts, that of the smallest hash. The curve
    is fitted for the share of label 1 among all labels. Without both labels every score is one half.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    ids = bounded_sample(known, "quality", "doc_id", sample)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text").between(1, chars))
    once = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    chosen = once.select("quality", "text", F.xxhash64("doc_id").alias("_at")).collect()
    share = known.agg(F.avg("quality")).first()[0] or 0.5
    texts = {q: [r["text"].encode() for r in sorted(chosen, key=lambda r: (r["_at"], r["text"])) if r["quality"] == q] for q in (0, 1)}
    cut = {q: int(len(t) * DICTIONARY_SHARE) for q, t in texts.items()}
    model = Model(dictionary(texts[1][: cut[1]]), dictionary(texts[0][: cut[0]]), 0.0, 0.0)
    feature = model.feature()
    x = np.array([feature(t) for q in (0, 1) for t in texts[q][cut[q] :]])
    y = np.array([q for q in (0, 1) for _ in texts[q][cut[q] :]])
    if all(texts.values()):
        model.slope, model.offset = logistic(x, y, share)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from the whole text alone: the chance, 0 to 1, that the label is 1.

    Null and empty texts have difference 0 and the score that belongs to it. Repeated rows repeat, a null doc_id is carried, other
    columns are ignored, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = model.feature()
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([feature(t.as_py() or b"") for t in part.column("text").cast(pa.binary())])
                s = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
