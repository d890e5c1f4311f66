"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select("u", "v", "m")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(joined.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v: two long columns), root the smallest node reachable.

    Alternating large and small stars: about log(nodes) rounds, each two grouped minima joined
    back; no neighbour list is ever gathered. Rows with a null and loops are ignored; repeated
    edges count once; without edges there are no rows.
    """
    e = edges.toDF("u", "v").where("u <> v")
    state = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        state = written(_small_star(_large_star(state)), "edges")
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
