"""Merges that read and replace only the part of a stored table that they touch.

A table is plain Parquet, partitioned by a hash bucket of its key. A delivery names its buckets (at most ``n``, whatever its
size); the merge reads those partitions, merges with the rules of ``upsert`` and replaces them by a dynamic partition overwrite. Other
partitions are neither read nor written. A merge that was broken off is repeated as a whole: the rules give the same rows when the
same delivery meets rows it has already changed.

A replaced partition always holds one row without a key besides its rows, so that one that loses its last row is
replaced too; ``read`` leaves such rows out, and keys are never null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from reviewatlas.functions.frames import keep_one
from reviewatlas.operators import upsert as up
from reviewatlas.sources.writers import overwrite_partitions

BUCKET = "bucket"
#: Buckets of a table; part of its layout.
BUCKETS = 64


def bucket_of(keys: Sequence[str], n: int = BUCKETS) -> Column:
    return F.pmod(F.hash(*keys), F.lit(n)).cast("int")


def touched(rows: DataFrame, keys: Sequence[str], n: int = BUCKETS) -> list[int]:
    """The buckets of the rows' keys: at most ``n`` numbers."""
    return sorted(r[0] for r in rows.dropna(subset=list(keys)).select(bucket_of(keys, n).alias(BUCKET)).distinct().collect())


def read(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a bucketed table, of the given buckets only. A table that does not exist yet has no rows."""
    full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], full)
    if only is not None:
        rows = rows.filter(F.col(BUCKET).isin(list(only)))
    return rows.dropna(subset=list(keys)).drop(BUCKET)


def write(rows: DataFrame, path: str, keys: Sequence[str], buckets: Sequence[int], n: int = BUCKETS) -> None:
    """Replace the given buckets by ``rows``, which belong there."""
    placed = rows.withColumn(BUCKET, bucket_of(keys, n))
    marks = rows.sparkSession.createDataFrame([(b,) for b in buckets], f"{BUCKET} int")
    # rebalancing gives a bucket as many files as its size needs, and small buckets share a task
    overwrite_partitions(placed.unionByName(marks, allowMissingColumns=True).hint("rebalance", BUCKET), path, [BUCKET])


def store(rows: DataFrame, path: str, keys: Sequence[str], n: int = BUCKETS) -> None:
    """Write a table for the first time. Rows without a key are left out."""
    write(rows.dropna(subset=list(keys)), path, keys, range(n), n)


def merge(
    spark: SparkSession, path: str, schema: StructType, source: DataFrame, keys: Sequence[str], n: int = BUCKETS, **rules: object
) -> list[int]:
    """``upsert`` of a delivery into a stored table; the buckets that were replaced. ``rules`` are those of ``upsert``."""
    source = source.dropna(subset=list(keys))
    only = touched(source, keys, n)
    if only:
        write(up.upsert(read(spark, path, schema, keys, only), source, keys, **rules), path, keys, only, n)
    return only


def insert(spark: SparkSession, path: str, schema: StructType, source: DataFrame, keys: Sequence[str], n: int = BUCKETS) -> list[int]:
    """``insert_missing`` of a delivery into a stored table."""
    source = source.dropna(subset=list(keys))
    only = touched(source, keys, n)
    if only:
        write(up.insert_missing(read(spark, path, schema, keys, only), source, keys), path, keys, only, n)
    return only


def replace(
    spark: SparkSession, path: str, schema: StructType, fresh: DataFrame, parent: str, covered: DataFrame | None = None, n: int = BUCKETS
) -> list[int]:
    """``replace_children`` in a table bucketed by ``parent``: the children of the covered parents (those of ``fresh`` if not given) go,
    the fresh ones come. A covered parent without fresh children loses all."""
    ids = (fresh if covered is None else covered).select(parent).dropna().distinct()
    only = touched(ids, [parent], n)
    if only:
        kept = up.replace_children(read(spark, path, schema, [parent], only), fresh.dropna(subset=[parent]), parent, ids)
        write(kept, path, [parent], only, n)
    return only


def relink(spark: SparkSession, path: str, schema: StructType, moves: DataFrame, key: str, value: str, n: int = BUCKETS) -> list[int]:
    """``relink`` of the key a table is bucketed by: rows move from the old key's bucket to the new one's.

    ``moves`` has ``key`` and ``value``; a key with several values takes the largest. All buckets that rows leave or reach are replaced in
    one job, so a row is never missing. A broken-off job is repeated with the same moves; they must not chain (see ``moves.resolved``),
    or rows would go on to the next key.
    """
    once = moves.dropna(subset=[key, value]).groupBy(key).agg(F.max(value).alias(value))
    both = once.select(F.col(key).alias("_k")).union(once.select(value)).distinct()
    only = touched(both.withColumnRenamed("_k", key), [key], n)
    if only:
        write(up.relink(read(spark, path, schema, [key], only), once, key, value, key), path, [key], only, n)
    return only


def lookup(spark: SparkSession, path: str, schema: StructType, wanted: DataFrame, keys: Sequence[str], n: int = BUCKETS) -> DataFrame:
    """The stored rows of the wanted keys: reads their buckets, and keeps the small side on the right."""
    ids = wanted.select(*keys).dropna().distinct()
    return read(spark, path, schema, keys, touched(ids, keys, n)).join(ids, list(keys), "left_semi")


def merge_all(spark: SparkSession, path: str, schema: StructType, deliveries: Sequence[DataFrame], keys: Sequence[str], n: int = BUCKETS) -> list[int]:
    """Several deliveries as one merge: of a key the row of the last delivery counts, and a bucket is replaced once."""
    numbered = [d.withColumn("_delivery", F.lit(i)) for i, d in enumerate(deliveries)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    order = [F.desc("_delivery"), *[F.col(c).desc_nulls_last() for c in rows.columns if c not in (*keys, "_delivery")]]
    return merge(spark, path, schema, keep_one(rows, list(keys), order).drop("_delivery"), keys, n)
