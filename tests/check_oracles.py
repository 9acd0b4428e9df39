"""Run every registered query beside its SQL and compare all values (a tool, not a test)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
         "BOOLEAN": "boolean"}


def cell(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(cell(i) for i in x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf, name, query, sql):
    """(verdict, rows, seconds)"""
    t0 = time.time()
    df = query(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    secs = time.time() - t0
    if sql is None:
        return "rows-only", len(rows), secs
    rel = con.sql(sql)
    got = table(df.columns, rows)
    want = table(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} vs {want[0]}", len(rows), secs
    kinds = dict(zip(rel.columns, (TYPES.get(str(t), str(t).lower()) for t in rel.types)))
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return f"VALUES {len(got[1])} vs {len(want[1])} {bad}", len(rows), secs
    off = {c: (k, kinds[c]) for c, k in df.dtypes if kinds[c] != k and not k.startswith("array")}
    return (f"ok TYPES {off}" if off else "ok"), len(rows), secs


def main(sf, pattern=""):
    from __spark_entry__ import oracle_sql, queries
    from fleetlens.plans.session import local_session
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), oracle_sql(), 0
    for name, query in queries().items():
        if pattern and not any(name.startswith(p) for p in pattern.split(",")):
            continue
        try:
            verdict, n, secs = compare(spark, con, sf, name, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            verdict, n, secs = "ERROR " + str(error)[:700], -1, 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:42s} {n:7d} {secs:6.2f}s  {verdict}", flush=True)
    print("queries with a difference:", bad)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(*sys.argv[1:])
