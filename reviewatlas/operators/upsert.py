"""Merges over plain tables: one keyed full-outer join with a policy per column.

Policies: ``overwrite`` (the new row wins), ``fill`` (a new non-null value wins), ``keep``
(the old row wins) or a callable ``(old, new) -> Column``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.functions.frames import keep_one

Policy = str | Callable[[Column, Column], Column]


def guarded(values: Sequence[str | None]) -> Callable[[Column, Column], Column]:
    """Overwrite only where the old value is one of ``values`` (None stands for null)."""

    def pick(old: Column, new: Column) -> Column:
        replaceable = old.isin(*[v for v in values if v is not None])
        if None in values:
            replaceable = replaceable | old.isNull()
        return F.when(replaceable, new).otherwise(old)

    return pick


def _merge(policy: Policy, old: Column, new: Column) -> Column:
    if callable(policy):
        return policy(old, new)
    if policy == "overwrite":
        return new
    if policy == "fill":
        return F.coalesce(new, old)
    if policy == "keep":
        return old
    raise ValueError(f"unknown policy {policy!r}")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    policy: Policy | Mapping[str, Policy] = "overwrite",
    insert: Mapping[str, Column] | None = None,
    insert_new: bool = True,
    only_if: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Merge ``source`` into ``target``. ``only_if`` sees the old row as a struct; where it is
    not true the old row stays as it is.

    With a mapping, columns without a policy keep the old value; rows that are new take the
    source values, or the ``insert`` expression of a column where one is given. The source is
    reduced to one row per key first (largest row), so reruns give the same result.
    """
    keys = list(keys)
    values = [c for c in source.columns if c not in keys]
    once = keep_one(source, keys, [F.col(c).desc_nulls_last() for c in values])
    insert = insert or {}
    fresh = once.select(
        *keys, F.struct(*[F.col(c) for c in values]).alias("_new"),
        F.struct(*[insert.get(c, F.col(c)).alias(c) for c in values]).alias("_ins"),
    )
    held = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    both = held.join(fresh, keys, "full" if insert_new else "left")

    def column(name: str) -> Column:
        old = F.col("_old").getField(name)
        if name not in values:
            return old.alias(name)
        new = F.col("_new").getField(name)
        rule = policy.get(name, "keep") if isinstance(policy, Mapping) else policy
        merged = F.when(F.col("_new").isNull(), old)
        merged = merged.when(F.col("_old").isNull(), F.col("_ins").getField(name))
        if only_if is not None:
            merged = merged.when(~F.coalesce(only_if(F.col("_old")), F.lit(False)), old)
        return merged.otherwise(_merge(rule, old, new)).alias(name)

    return both.select(*[c if c in keys else column(c) for c in target.columns])


def unseen_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], long_history: bool = False) -> DataFrame:
    """Rows of the source whose key the target does not hold.

    ``long_history``: the target is far larger than the delivery. It is then cut to the
    delivery's keys by a semi join with the small side on the right, so the history is scanned
    for its key column but not shuffled; the source is evaluated twice for it.
    """
    keys = list(keys)
    held = target.select(*keys)
    if long_history:
        held = held.join(source.select(*keys).distinct(), keys, "left_semi").distinct()
    return source.join(held, keys, "left_anti")


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], long_history: bool = False) -> DataFrame:
    """Insert-or-ignore: rows of the source whose key the target does not hold. Copies are
    dropped first, inside the map tasks, so that a key with many copies stays small."""
    once = keep_one(source, keys, [F.col(c).asc_nulls_last() for c in source.columns])
    fresh = unseen_rows(target, once, keys, long_history)
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def replace_children(children: DataFrame, fresh: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """Drop all children of the touched parents, then add the fresh ones."""
    ids = (touched if touched is not None else fresh).select(parent).distinct()
    kept = children.join(ids, parent, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).select(*children.columns)


def relink(target: DataFrame, mapping: DataFrame, key: str, value: str, column: str) -> DataFrame:
    """Update-from-join: ``column`` takes ``mapping.value`` where ``target.column key`` matches."""
    once = mapping.groupBy(F.col(key).alias("_k")).agg(F.max(value).alias("_v"))
    joined = target.join(once, F.col(key) == F.col("_k"), "left")
    new = F.coalesce("_v", column).alias(column)
    return joined.select(*[new if c == column else c for c in target.columns])


def update_where(df: DataFrame, cond: Column, **values: Column) -> DataFrame:
    """Conditional update; a null condition leaves the row as it is."""
    return df.select(
        *[
            F.when(cond, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def retain_truth(df: DataFrame, truth: DataFrame, key: str, scope: Column) -> DataFrame:
    """Inside the scope keep only keys of the truth set; rows outside are untouched."""
    inside = F.coalesce(scope, F.lit(False))
    known = truth.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    joined = df.join(known, key, "left")
    return joined.filter(~inside | F.col("_known")).select(*df.columns)


def set_status(df: DataFrame, ids: DataFrame, key: str, status: str, column: str = "mining_status") -> DataFrame:
    """Move the given ids to a status."""
    return relink(df, ids.select(key).withColumn("_to", F.lit(status)), key, "_to", column)


# Notes on closed requests.
FOUND_NOTE, FOUND_END, MISSING_NOTE = " [Found Parent: ", "]", " [Parent Not Found]"


def advance_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Close queue rows in progress. ``outcomes``: (asin, parent), parent null when not found."""
    found = outcomes.groupBy("asin").agg(F.max("parent").alias("_parent")).withColumn("_done", F.lit(True))
    joined = queue.join(found, "asin", "left")
    active = F.col("_done") & (F.col("status") == "IN_PROGRESS")
    status = F.when(F.col("_parent").isNotNull(), "COMPLETED").otherwise("FAILED")
    remark = F.when(
        F.col("_parent").isNotNull(), F.concat(F.lit(FOUND_NOTE), F.col("_parent"), F.lit(FOUND_END))
    ).otherwise(MISSING_NOTE)
    note = F.concat(F.coalesce("note", F.lit("")), remark)
    return update_where(joined, active, status=status, note=note).select(*queue.columns)


def latest_status(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Current status of every key of an append-only status log."""
    return log.groupBy(key).agg(F.max_by("status", seq).alias("status"), F.max(seq).alias(seq))


def move_key(
    products: DataFrame, reviews: DataFrame, parents: DataFrame, moves: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move families ``old -> new`` over the tables; an emptied old family is dropped."""
    moved_products = relink(products, moves.withColumnRenamed("old", "parent_asin"), "parent_asin", "new", "parent_asin")
    moved_reviews = relink(reviews, moves.withColumnRenamed("old", "parent_asin"), "parent_asin", "new", "parent_asin")
    heirs = (
        moves.withColumnRenamed("old", "parent_asin")
        .join(parents, "parent_asin")
        .drop("parent_asin")
        .withColumnRenamed("new", "parent_asin")
    )
    with_heirs = insert_missing(parents, heirs, ["parent_asin"])
    emptied = (
        moves.select(F.col("old").alias("parent_asin"))
        .join(moved_products.select("parent_asin").distinct(), "parent_asin", "left_anti")
    )
    return moved_products, moved_reviews, with_heirs.join(emptied, "parent_asin", "left_anti")
