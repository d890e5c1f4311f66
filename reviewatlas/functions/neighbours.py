"""Exact nearest rows on a number line, and substring joins, without emitting all pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewatlas.functions.frames import top_k

_STEPS = 4  # blocks per octave


def _block(x: Column) -> Column:
    return F.when(x <= 0, F.lit(-1)).otherwise(F.floor(F.log2(x) * _STEPS)).cast("int")


def nearest_within(
    points: DataFrame, group: Sequence[str], x: str, key: str, k: int, bands: Sequence[tuple[float, float]]
) -> DataFrame:
    """For every (group, x): the ``k + 1`` nearest keys inside each band around x.

    ``bands`` are factors of x, such as (0.6, 1.4). Result columns: group, x and one array
    ``near_<i>`` per band of structs (diff, key, x), nearest first, ties by key.

    Per (group, x) only the ``k + 1`` smallest keys can ever be chosen, so the rest is dropped
    before any ordering. Each group is cut into blocks of x (four per octave): rows look for
    neighbours in their own block through a bounded window frame, and each block receives the
    ``k + 1`` rows next to its edges from the blocks its bands can reach. The work is linear
    in the rows; a hot group is spread over its blocks.
    """
    group = list(group)
    g = [*group, "_b"]
    item = F.struct(F.col(x).alias("x"), F.col(key).alias("key"))
    lo, hi = min(b[0] for b in bands), max(b[1] for b in bands)
    left_reach = math.ceil(-math.log2(lo) * _STEPS) + 1
    right_reach = math.ceil(math.log2(hi) * _STEPS) + 1

    items = top_k(points.select(*group, x, key), [*group, x], [F.col(key)], k + 1).withColumn(
        "_b", _block(F.col(x))
    )
    up = Window.partitionBy(*g).orderBy(F.asc(x), F.asc(key))
    down = Window.partitionBy(*g).orderBy(F.desc(x), F.asc(key))
    starts = F.coalesce(F.lag(x).over(up) != F.col(x), F.lit(True))
    ends = F.coalesce(F.lead(x).over(down) != F.col(x), F.lit(True))
    cells = (
        items.select(
            *g, x,
            F.when(starts, F.collect_list(item).over(up.rowsBetween(0, k))).alias("_right"),
            F.when(ends, F.collect_list(item).over(down.rowsBetween(1, k + 1))).alias("_left"),
        )
        .groupBy(*g, x)
        .agg(F.first("_right", True).alias("_right"), F.first("_left", True).alias("_left"))
    )

    def halo(order: Sequence[Column], first: int, last: int, name: str) -> DataFrame:
        edge = top_k(items, g, order, k + 1)
        targets = F.sequence(F.col("_b") + first, F.col("_b") + last)
        sent = edge.select(*group, F.explode(targets).alias("_b"), x, key)
        return top_k(sent, g, order, k + 1).groupBy(*g).agg(F.collect_list(item).alias(name))

    below = halo([F.desc(x), F.asc(key)], 1, left_reach, "_below")
    above = halo([F.asc(x), F.asc(key)], -right_reach, -1, "_above")
    none = F.array().cast("array<struct<x:bigint,key:string>>")
    around = F.concat(*[F.coalesce(c, none) for c in ("_left", "_right", "_below", "_above")])
    joined = cells.join(below, g, "left").join(above, g, "left").withColumn("_all", around)

    def nearest(band: tuple[float, float]) -> Column:
        inside = F.filter(
            "_all", lambda e: e["x"].between(F.col(x) * F.lit(band[0]), F.col(x) * F.lit(band[1]))
        )
        ranked = F.transform(
            inside,
            lambda e: F.struct(F.abs(e["x"] - F.col(x)).alias("diff"), e["key"].alias("key"), e["x"].alias("x")),
        )
        return F.slice(F.array_sort(ranked), 1, k + 1)

    return joined.select(*group, x, *[nearest(b).alias(f"near_{i}") for i, b in enumerate(bands)])


def containment_pairs(needles: DataFrame, needle: str, hay: DataFrame, value: str, width: int = 6) -> DataFrame:
    """Distinct (needle, value) with the needle inside the value, ignoring case.

    The value is cut into all its pieces of up to ``width`` characters and joined by equality
    with the needle's first piece; only pairs that share it are compared in full.
    """
    low = F.lower(needle)
    keyed = needles.select(needle).distinct().withColumn("_gram", F.substring(low, 1, width))
    # a needle shorter than the width meets pieces of its own length
    pieces = F.explode(F.sequence(F.lit(1), F.length(value)))
    grams = (
        hay.select(value).distinct()
        .filter(F.length(value) > 0)
        .withColumn("_at", pieces)
        .withColumn("_len", F.explode(F.sequence(F.lit(1), F.lit(width))))
        .filter(F.col("_at") + F.col("_len") - 1 <= F.length(value))
        .select(value, F.expr(f"substring(lower({value}), _at, _len)").alias("_gram"))
        .distinct()
    )
    return (
        keyed.join(grams, "_gram")
        .filter(F.lower(value).contains(low))
        .select(needle, value)
        .distinct()
    )
