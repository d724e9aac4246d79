"""Runs a query and its SQL side by side."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame.select(*columns).collect()), key=repr)


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=repr)
