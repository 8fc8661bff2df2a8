"""Rows of a query against those of its SQL in DuckDB: as multisets, with names and types."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(df, sql, con):
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    types = {x[0]: str(x[1]) for x in found.description}
    assert {c: types[c] for c in columns} == {c: TYPES[t] for c, t in df.dtypes}
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
