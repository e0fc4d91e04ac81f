"""Compares a query's rows with its SQL on DuckDB."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return x
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {only[0]}; only in SQL {only[1]}"
    return ""
