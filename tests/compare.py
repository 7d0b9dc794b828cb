"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb


def rows_of(columns, rows):
    def plain(x):
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want.fetchall())
