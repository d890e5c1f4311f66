"""DataFrame building blocks: per-group selection, paging and bucketed ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewatlas.session import scratch_path

Keys = str | Sequence[str]


def _list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_k(df: DataFrame, by: Keys, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group.

    Spark prunes each map task to ``k`` rows per group before the shuffle
    (``WindowGroupLimit``), so a hot group never arrives whole in one task.
    ``order`` must be total.
    """
    w = Window.partitionBy(*_list(by)).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """An exchange of its own on fine keys.

    A step that reuses the partitioning of a join keeps adaptive execution from splitting that
    join where a key is hot. With this exchange in between the join may be split, and a group
    limit that follows prunes before it gathers.
    """
    return df.repartition(*columns)


def keep_one(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    return top_k(df, keys, order, 1)


def text_key(column: str) -> Column:
    """What a long text is carried under: the first half of its SHA-256, null for null."""
    return F.substring(F.unhex(F.sha2(F.col(column), 256)), 1, 16)


def apart(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the digest of a long text in its place, the different texts under ``_key``).

    Joins, windows and sorts then move 16 bytes for a text of any length. Equal digests mean equal texts, so groups by the text stay the
    same; its order is lost. The texts are made unique inside the map tasks and cross the network once. ``df`` is evaluated twice.
    """
    texts = df.select(text_key(column).alias("_key"), F.col(column).alias("_whole")).dropna().distinct()
    return df.withColumn(column, text_key(column)), texts


def whole(rows: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """The rows of ``apart``, or what is left of them, with their texts again."""
    found = rows.join(texts, F.col(column) == F.col("_key"), "left")
    return found.withColumn(column, F.col("_whole")).drop("_key", "_whole")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again, for several readers of what is dear to make."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_lists(df: DataFrame, keys: Keys, item: str, out: str, length: int = 8, sep: str = ",") -> DataFrame:
    """Join a group's items to ordered text, one row per prefix of ``length`` characters.

    Where an item goes depends on the item alone, so a group has the same shape at every size: read in the order
    of ``prefix``, its rows are its whole ordered list. A row holds at most the ids that share a prefix.
    """
    keys = _list(keys)
    placed = df.filter(F.col(item).isNotNull()).withColumn("prefix", F.substring(item, 1, length))
    return placed.groupBy(*keys, "prefix").agg(F.array_join(F.array_sort(F.collect_list(item)), sep).alias(out))


def previous_rows(df: DataFrame, keys: Keys, ts: str, columns: Sequence[str], cell_hours: int = 24) -> DataFrame:
    """Add ``prev_<column>`` from the row before in time order (ties by the columns).

    The order is cut into time cells: ``lag`` runs inside (key, cell), and the first row of a
    cell takes the last row of the cell before. A hot key is thus split over its cells; the
    only window over a whole key runs on one row per cell.
    """
    keys = _list(keys)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    cells = df.withColumn("_cell", F.floor(second / (cell_hours * 3600)))
    row = F.struct(ts, *columns)
    inside = Window.partitionBy(*keys, "_cell").orderBy(ts, *columns)
    rows = cells.withColumn("_prev", F.lag(row).over(inside))
    across = Window.partitionBy(*keys).orderBy("_cell")
    carry = (
        cells.groupBy(*keys, "_cell")
        .agg(F.max(row).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .select(*keys, "_cell", "_carry")
    )
    prev = F.coalesce("_prev", "_carry")
    return rows.join(carry, [*keys, "_cell"]).select(
        *df.columns,
        prev[ts].alias(f"prev_{ts}"),
        *[prev[c].alias(f"prev_{c}") for c in columns],
    )


def exact_median(df: DataFrame, keys: Keys, value: str, out: str) -> DataFrame:
    """Exact median of a whole-number column per group.

    Values are counted first; the two middle ranks are then located in blocks of an eighth of
    an octave, and only the values of those blocks are ordered. No task sees a whole group.
    """
    keys = _list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("bigint").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_block",
            (F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * 8)).cast("bigint"),
        )
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    blocks = (
        counts.groupBy(*keys, "_block")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .withColumn("_lo", F.expr("(_total + 1) div 2"))
        .withColumn("_hi", F.expr("_total div 2 + 1"))
        .filter((F.col("_before") < F.col("_hi")) & (F.col("_upto") >= F.col("_lo")))
        .select(*keys, "_block", "_before", "_lo", "_hi")
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy("_v")
    run = F.col("_before") + F.sum("_n").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(blocks, [*keys, "_block"]).withColumn("_run", run)

    def at(rank: str) -> Column:
        hit = (F.col("_run") >= F.col(rank)) & (F.col("_run") - F.col("_n") < F.col(rank))
        return F.max(F.when(hit, F.col("_v")))

    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2.0).alias(out))


def flatten_structs(df: DataFrame, sep: str = "/") -> DataFrame:
    """Flatten nested struct columns to ``a/b`` names."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: str, label: str) -> list[Column]:
        out: list[Column] = []
        for field in schema.fields:
            here, name = f"{path}`{field.name}`", f"{label}{field.name}"
            if isinstance(field.dataType, StructType):
                out += walk(field.dataType, f"{here}.", f"{name}{sep}")
            else:
                out.append(F.col(here).alias(name))
        return out

    return df.select(walk(df.schema, "", ""))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
