"""Readers. Schemas are always given: nothing is inferred by an extra pass over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewatlas.operators.clean import valid_scrapes

CORRUPT = "_corrupt_record"
#: How the library's CSV files are written: a quote inside a value is doubled, values may hold line breaks, backslashes are plain.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON record per line, with the file it came from in ``_metadata``."""
    return spark.read.schema(schema).json(path).select("*", "_metadata")


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each. A file is read by one task: many small files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A spreadsheet exported as CSV with a header."""
    return spark.read.schema(schema).options(**CSV).option("enforceSchema", False).csv(path)


def read_sheet_as_text(spark: SparkSession, path: str) -> DataFrame:
    """The same with every column as text; only the header line is looked at."""
    return spark.read.options(**CSV).option("inferSchema", False).csv(path)


def read_feed(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A feed CSV: columns named as ids stay text whatever they look like."""
    fields = ", ".join(f"`{n}` {'string' if n == 'id' or n.endswith('_id') else t}" for n, t in columns.items())
    return spark.read.schema(fields).options(**CSV).csv(path)


def read_scrapes(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected lines) of a scrape dump. Blank lines are skipped, unreadable
    lines go to the rejects, and only found pages with a title are valid."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = lines.select(
        "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")
    )
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    good = valid_scrapes(parsed.filter(~bad).select("r.*").drop(CORRUPT))
    return good, parsed.filter(bad).select(F.col("value").alias("line"))


def read_matching(
    spark: SparkSession, path: str, fmt: str, schema: StructType | str, glob: str = "*", name_parts: Sequence[str] = ()
) -> DataFrame:
    """All files of a folder whose name fits the glob and holds one of the parts, with the path (``file``) and name of each row's file."""
    options = CSV if fmt == "csv" else {}
    df = spark.read.format(fmt).schema(schema).option("pathGlobFilter", glob).options(**options).load(path)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    if not name_parts:
        return df
    hit = F.lit(False)
    for part in name_parts:
        hit = hit | F.col("file_name").contains(part)
    return df.filter(hit)


def files_holding(rows: DataFrame, targets: DataFrame, key: str, file: str = "file") -> DataFrame:
    """(file, id, rows) for every target id a file holds."""
    return rows.join(targets.select(key).distinct(), key, "left_semi").groupBy(file, key).agg(F.count("*").alias("rows"))


def files_by_row_count(rows: DataFrame, counts: Sequence[int], file: str = "file") -> DataFrame:
    """Files with one of the given row counts."""
    return rows.groupBy(file).agg(F.count("*").alias("rows")).filter(F.col("rows").isin(*counts))


def query(spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with ``:name`` parameters over frames named in braces."""
    return spark.sql(text, args=dict(args or {}), **tables)


def query_one(spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **tables: DataFrame):
    """First value of the first row, or None."""
    row = query(spark, text, args, **tables).limit(1).first()
    return row[0] if row else None


def attach(spark: SparkSession, base: str, names: Sequence[str], prefix: str) -> None:
    """Make a snapshot's tables visible as views ``<prefix>_<name>``."""
    for name in names:
        spark.read.parquet(f"{base.rstrip('/')}/{name}").createOrReplaceTempView(f"{prefix}_{name}")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Model response lines (column ``value``)."""
    return spark.read.text(path)
