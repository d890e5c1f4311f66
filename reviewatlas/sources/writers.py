"""Sinks: files, versioned snapshots, event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewatlas.operators.upsert import update_where
from reviewatlas.schemas import conform


#: Rows of a file that cannot be split.
FILE_ROWS = 200_000


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line, compressed (``*.json.lz4``). A compressed file is read by one task, so its rows are limited."""
    df.write.mode(mode).option("compression", "lz4").option("maxRecordsPerFile", FILE_ROWS).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; also what a spreadsheet program opens."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text line per row (column ``value``), such as request documents, compressed (``*.txt.lz4``) in files of limited rows, as ``write_ndjson`` does."""
    df.select("value").write.mode(mode).option("compression", "lz4").option("maxRecordsPerFile", FILE_ROWS).text(path)


def append_by_name(df: DataFrame, schema: StructType | str, paths: Sequence[str]) -> None:
    """Append to every replica, columns matched by name, absent ones null."""
    rows = conform(df, schema)
    for path in paths:
        rows.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str], **options: object) -> None:
    """Replace only the partitions that occur in ``df``."""
    df.write.mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def log_events(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to the event log, one folder per type and day."""
    dated = df.withColumn("date", F.to_date(ts))
    dated.write.mode("append").partitionBy("event_type", "date").json(path)


# --- versioned snapshots ------------------------------------------------------------------


def current_version(spark: SparkSession, base: str) -> int | None:
    """Newest published version; the pointer table holds one row per version."""
    try:
        return spark.read.schema("version bigint").parquet(f"{base}/_pointer").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def publish(df: DataFrame, base: str) -> int:
    """Write the next version beside the old ones, then point readers at it. A failed write
    leaves the pointer, and so the readers, on the old version. One writer per table."""
    spark = df.sparkSession
    version = (current_version(spark, base) or 0) + 1
    df.write.mode("overwrite").parquet(f"{base}/v={version}")
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(f"{base}/_pointer")
    return version


def current(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The published table, or one of its earlier versions."""
    found = version if version is not None else current_version(spark, base)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {base}")
    return spark.read.parquet(f"{base}/v={found}")


def mark_scraped(tracking: DataFrame, ids: DataFrame, when: str) -> DataFrame:
    """Tracking sheet after a scrape: status and time of the given families."""
    done = ids.select(F.trim("asin").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = tracking.join(done, F.trim("Parent Asin") == F.col("_k"), "left")
    out = update_where(joined, F.col("_hit"), **{"Status": F.lit("Scraped"), "Last Scraped At": F.lit(when)})
    return out.select(*[f"`{c}`" for c in tracking.columns])


def pending(tracking: DataFrame, k: int) -> DataFrame:
    return tracking.filter("Status = 'Pending'").select("Parent Asin").orderBy("Parent Asin").limit(k)
