"""Runs a query and its SQL over the smallest tables and compares their rows."""

from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")


def _clean(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_clean(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql):
    df = query(spark, str(SF))
    mine = rows(df.columns, df.collect())
    if sql is None:
        return
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, cur.fetchall())
