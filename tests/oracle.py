"""Comparison of a query with its SQL in DuckDB: columns by name, rows in any order, exact values."""

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(v[i]) for i in order]) for v in values)


def differences(spark, folder, name, run, sql, con=None):
    """None if the query and its SQL agree, else what differs first."""
    df = run(spark, folder)
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = (con or connect(folder)).execute(sql)
    want_columns, want = rows([d[0] for d in found.description], found.fetchall())
    if got_columns != want_columns:
        return f"{name}: columns {got_columns} and {want_columns}"
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{name}: {len(got)} and {len(want)} rows; here only {only[0]}, there only {only[1]}"
    return None
