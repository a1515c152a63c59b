"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares columns, types and rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

BASE = "/root/testdata/sf0.01"


def connection(base: str = BASE) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(base).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v: object) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows(columns: list[str], values: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in values)


def difference(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same, else what differs first."""
    res = con.execute(sql)
    names, kinds = [d[0] for d in res.description], [str(d[1]) for d in res.description]
    theirs = res.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    types = {n: same.get(t, t) for n, t in df.dtypes}
    if bad := [(n, types[n], k) for n, k in zip(names, kinds, strict=True) if types[n] != k]:
        return f"types {bad}"
    a, b = rows(df.columns, ours), rows(names, theirs)
    if len(a) != len(b):
        extra = (sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2])
        return f"{len(a)} and {len(b)} rows: {extra}"
    return next((f"{x} and {y}, {sum(p != q for p, q in zip(a, b, strict=True))} of {len(a)} rows" for x, y in zip(a, b, strict=True) if x != y), "")


def main(names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from biblioweave.session import local_session

    spark: SparkSession = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connection(), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = f(spark, BASE)
            text = difference(df, sql[name], con) if name in sql else f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {text or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
