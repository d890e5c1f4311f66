"""Chained moves of families: every id goes to the end of its chain, by pointer jumping.

Each round replaces a target by the target's own target, so the distance covered doubles: a chain of a thousand moves takes ten
rounds, each one equi-join of the moves with themselves. Ids on or before a cycle have no end; they are reported instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.operators.upsert import move_key
from reviewatlas.session import scratch_path


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: a round starts from files, and a lost executor costs one read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolved(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves to the end of each chain, ids that have none) of ``moves`` (old, new).

    The first has old, new and the number of single moves between (``steps``), the second the column ``old``: ids that are on a
    cycle or lead into one. Rows with a null and moves of an id to itself are ignored; of several targets of an id the largest counts.
    """
    names = moves.select(F.col("old").cast("string"), F.col("new").cast("string")).where("old <> new")
    state = _kept(names.groupBy("old").agg(F.max("new").alias("new")).withColumn("steps", F.lit(1).cast("bigint")), "moves")
    total = state.count()
    while True:
        onward = state.select(F.col("old").alias("_at"), F.col("new").alias("_next"), F.col("steps").alias("_more"))
        joined = state.join(onward, F.col("new") == F.col("_at"), "left")
        # after k rounds an id that goes on has covered 2^k steps; more than there are moves is a cycle
        jumped = _kept(joined.select(
            "old", F.coalesce("_next", "new").alias("new"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_at").isNotNull().alias("on"),
        ), "moves")
        mark = jumped.where("on").agg(F.count("*").alias("n"), F.min("steps").alias("least")).first()
        state = jumped.drop("on")
        if not mark["n"] or mark["least"] > total:
            ended = jumped.where("NOT on").drop("on")
            return ended, jumped.where("on").select("old")


def move_families(
    products: DataFrame, reviews: DataFrame, parents: DataFrame, moves: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``move_key`` along whole chains: (products, reviews, parents, ids on cycles). Families on cycles stay where they are."""
    ends, cycles = resolved(moves)
    return *move_key(products, reviews, parents, ends.select("old", "new")), cycles
