"""Comparing a query with its SQL over a folder of parquet tables."""

import glob
import os

FOLDER = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def both(spark, query, sql, folder=FOLDER):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    got = sorted(repr([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    return got, sorted(repr([_plain(r[i]) for i in at]) for r in rel.fetchall())
