"""Run SQL on the star-schema tables and compare with a DataFrame, whatever the row order."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _canonical(columns, cursor.fetchall())


def frame_rows(df) -> tuple[list[str], list[tuple]]:
    return _canonical(df.columns, [tuple(r) for r in df.collect()])


def _canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)
