"""Run registered queries next to their SQL twins and compare the values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A comparable form; null and NaN are told apart from numbers."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(round(float(value), 9) + 0.0))
    if hasattr(value, "isoformat"):
        if getattr(value, "tzinfo", None) is not None:
            value = value.replace(tzinfo=None)
        return (3, value.isoformat())
    return (4, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, query, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir) if not isinstance(query, tuple) else query[0](spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    got = rows_of(df.columns, got_rows)
    sql = query[1]
    if sql is None:
        return None if got_rows else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    odd = {c: k for c, k in kinds.items() if k.startswith(("HUGEINT", "DECIMAL", "STRUCT", "MAP")) or "[]" in k}
    if odd:
        return f"types {odd}"
    want = rows_of(columns, cur.fetchall())
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows against {len(want)} {sorted(columns)}\n  ours   {only_got}\n  theirs {only_want}"
    return None if want else "both sides empty"


def main() -> None:
    from reviewatlas.plans import registry
    from reviewatlas.session import build_session

    sf = os.environ.get("SF", "0.001")
    sf_dir = os.environ.get("SF_DIR", f"/root/testdata/sf{sf}")
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("OFF")
    con = open_tables(sf_dir)
    table = registry.load()
    names = [n for n in table if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, (registry.runner(name), table[name].oracle), sf_dir)
        except Exception as e:  # a report of every query is wanted
            problem = f"{type(e).__name__}: {" ".join(str(e).split("\tat")[0].split())[:700]}"
        bad += problem is not None
        if problem or "-v" in os.environ.get("CHECK", ""):
            print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
