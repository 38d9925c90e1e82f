"""Runs a query and its SQL and compares rows, columns by name."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 9)
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, name, query, sql, folder):
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns), (name, sorted(columns), sorted(df.columns))
    theirs = rows_of(columns, found.fetchall())
    assert len(ours) == len(theirs), (name, len(ours), len(theirs))
    differ = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not differ, (name, len(differ), differ[:3])
    return len(ours)
