"""Name -> query. A query takes the canonical tables and returns a DataFrame; its SQL twin,
where SQL can say it, is run by another engine as a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reviewatlas.plans.fixtures import Tables, sql


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] | list[str] = ()):
    """Register a query under ``name`` with the SQL body that checks it."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(fn, sql(oracle, *needs) if oracle else None)
        return fn

    return wrap


def load() -> dict[str, Query]:
    """All queries, grouped by topic."""
    from reviewatlas.plans import bucketed, cleaning, comparing, evidence, linking, moving, named, quality, searching, sessions, social, sqltools, stats, streams, summing, tables, tagging  # noqa: F401

    return QUERIES


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: load()[name].build(Tables(spark, sf_dir))
