"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewatlas.session import scratch_path

#: Fixed: the characters that separate words, tab to carriage return and the space.
SPACES = " \t\n\x0b\f\r"
#: Fixed: one word.
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there, and a lost
    executor costs one read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes.split() cuts exactly at the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_array(text: Column) -> Column:
    """The words as an array; null texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ", -1)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where the optimizer moves the expression into a filter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, the first in the order of a hash of ``key``; rows without either are left out.

    The groups are counted first, from two narrow columns; a threshold on the hash then leaves little more than the sample, so
    what one task ranks is bounded however large a group is. ``by`` has few values: their counts are read by the driver.
    """
    named = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(by).agg(F.count("*")).collect()}
    if not counts:
        return named
    share = F.create_map(*(F.lit(x) for group, n in sorted(counts.items()) for x in (group, (1.2 * most + 100) / n)))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    near = named.withColumn("_place", place).where(F.col("_place") < F.element_at(share, F.col(by)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_place", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_place", "_rank")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads 64-bit values over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(start, start + n, dtype=np.uint64) * GOLDEN)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``chars`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= chars:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
