"""Canonical tables written once and read by many queries, as an ingested store is used."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from reviewatlas.plans.fixtures import Tables

STORED = ["products", "product_parents", "_reviews", "review_tags", "review_tags_quoted", "aspect_mapping", "social_posts"]


def write_canonical(tables: Tables, base: str) -> None:
    """Write every stored table below ``base``; each is built from those before it."""
    store = StoredTables(tables.spark, tables.sf_dir, base)
    for name in STORED:
        # the definition of Tables, over what is already stored
        Tables.__dict__[name].func(store).write.parquet(f"{base}/{name}")


class StoredTables(Tables):
    """Tables that read the stored copies where there is one."""

    def __init__(self, spark: SparkSession, sf_dir: str, base: str):
        super().__init__(spark, sf_dir)
        self.base = base

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")


def _stored(name: str) -> cached_property:
    prop = cached_property(lambda self: self._read(name))
    prop.__set_name__(StoredTables, name)
    return prop


for _name in STORED:
    setattr(StoredTables, _name, _stored(_name))
