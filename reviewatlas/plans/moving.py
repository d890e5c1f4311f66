"""Registered queries: moves of families that follow each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewatlas.operators import moves
from reviewatlas.plans.registry import query

# Family heads in the order of their ids: in every twenty a chain that ends, a side move into each of its families, and a cycle with families before it.


def _moves(t):
    h = F.expr("CAST(substr(a, 2) AS BIGINT) DIV 5")
    back = F.concat(F.lit("A"), F.lpad(((h - 2) * 5).cast("string"), 9, "0"))
    chain = t.pairs.filter(h % 20 != 9).select(F.col("a").alias("old"), F.when(h % 20 == 15, back).otherwise(F.col("b")).alias("new"))
    side = t.pairs.select(F.concat(F.lit("T"), "a").alias("old"), F.col("b").alias("new"))
    return chain.union(side)


_SQL = """RECURSIVE steps AS (SELECT a, b, CAST(substr(a, 2) AS BIGINT) // 5 AS h FROM {pairs}),
    m AS (SELECT a AS old, CASE WHEN h % 20 = 15 THEN 'A' || lpad(CAST((h - 2) * 5 AS VARCHAR), 9, '0') ELSE b END AS new FROM steps WHERE h % 20 <> 9
      UNION ALL SELECT 'T' || a, b FROM steps),
    walk AS (SELECT old, new, 1 AS steps FROM m
      UNION ALL SELECT w.old, m.new, w.steps + 1 FROM walk w JOIN m ON m.old = w.new WHERE w.steps < 60),
    ends AS (SELECT old, new, CAST(steps AS BIGINT) AS steps FROM walk WHERE new NOT IN (SELECT old FROM m)),
    cyclic AS (SELECT old FROM m WHERE old NOT IN (SELECT old FROM ends))"""
_PAIRS = """(SELECT 'A' || lpad(CAST(x.p_partkey AS VARCHAR), 9, '0') AS a, 'A' || lpad(CAST(y.p_partkey AS VARCHAR), 9, '0') AS b
    FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 5 WHERE x.p_partkey % 5 = 0)"""
_WALK = "WITH " + _SQL.format(pairs=_PAIRS)


@query("moves_resolved", f"SELECT * FROM ({_WALK} SELECT * FROM ends)")
def _(t):
    return moves.resolved(_moves(t))[0]


@query("moves_on_cycles", f"SELECT * FROM ({_WALK} SELECT * FROM cyclic)")
def _(t):
    return moves.resolved(_moves(t))[1]


def _moved(t):
    tables = t.products.select("asin", "parent_asin"), t.reviews.select("review_id", "parent_asin"), t.product_parents.select("parent_asin", "title")
    return moves.move_families(*tables, _moves(t))


@query("move_families_products", f"SELECT asin, coalesce(new, parent_asin) AS parent_asin FROM products LEFT JOIN ({_WALK} SELECT * FROM ends) ON old = parent_asin", ["products"])
def _(t):
    return _moved(t)[0]


@query("move_families_reviews", f"SELECT review_id, coalesce(new, parent_asin) AS parent_asin FROM reviews LEFT JOIN ({_WALK} SELECT * FROM ends) ON old = parent_asin", ["reviews"])
def _(t):
    return _moved(t)[1]
