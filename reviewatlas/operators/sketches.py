"""Counts over any span of days from sketches kept per day.

A day's rows become three small sketches: of the different values (HyperLogLog), of the set of values (theta), and of the distribution of a
number (KLL). Days are merged, not added up again, so a span of a year reads 365 rows a key. Exact counts stay the
default elsewhere; the bounds below hold for nearly all keys (three standard errors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log of the sketch sizes, and the size of KLL.
LG, KLL = 12, 200
#: Relative error of a number of different values, and error of a rank as a share of all.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG / 2), 0.0267


def daily(rows: DataFrame, keys: list[str], ts: str, value: str | None = None, number: str | None = None) -> DataFrame:
    """(keys, day, n and sketches): of the different ``value``s, and of the whole ``number``s. Null values and numbers count for nothing."""
    sums = [F.count("*").alias("n")]
    if value:
        sums += [F.hll_sketch_agg(value, LG).alias("hll"), F.theta_sketch_agg(value, LG).alias("theta")]
    if number:
        sums += [F.kll_sketch_agg_bigint(F.col(number).cast("bigint"), KLL).alias("kll")]
    return rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(*sums)


def merged(days: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of whole spans: those of ``keys`` over all their days."""
    rules = {"n": F.sum, "hll": lambda c: F.hll_union_agg(c), "theta": lambda c: F.theta_union_agg(c), "kll": lambda c: F.kll_merge_agg_bigint(c)}
    return days.groupBy(*keys).agg(*[rule(c).alias(c) for c, rule in rules.items() if c in days.columns])


def different(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: str | Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(keys, left_only, shared, right_only): estimated sizes from merged theta sketches; a side without a row is empty."""
    a, b = left.select(*on, F.col("theta").alias("_a")), right.select(*on, F.col("theta").alias("_b"))
    both = a.join(b, on, "full")
    size = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0))
    shared = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.theta_sketch_estimate(F.theta_intersection("_a", "_b"))).otherwise(0)
    return both.select(*on, (size("_a") - shared).alias("left_only"), shared.alias("shared"), (size("_b") - shared).alias("right_only"))
