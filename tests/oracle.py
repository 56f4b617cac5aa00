"""Compare a query with its SQL on the small test tables."""

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir=SMALL):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, list | tuple | np.ndarray):
        return tuple(plain(x) for x in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def spark_rows(df):
    return sorted(repr(tuple(plain(x) for x in row)) for row in df.select(sorted(df.columns)).collect())


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(row[i]) for i in order)) for row in cursor.fetchall())
