"""Run a query in Spark and its check in DuckDB and compare the sorted rows."""

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    return str(x)


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(df, con, sql):
    """None if equal, else what differs."""
    result = con.execute(sql)
    want_cols, want = rows_of(result.fetchall(), [d[0] for d in result.description])
    got_cols, got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        gap = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} rows, {len(want)} expected; first differences {gap}"
    return None
