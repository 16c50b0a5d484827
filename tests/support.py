"""Side-by-side comparison of a query and its SQL, whatever the order of rows."""

from __future__ import annotations

import decimal
import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.7g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted([plain(r[k]) for k in at] for r in rows)


def duck(sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def sparked(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
