"""Compare Spark rows with DuckDB rows, column by column name and regardless of order."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([_plain(row[i]) for i in order] for row in rows), key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    result = con.execute(sql)
    return table([c[0] for c in result.description], result.fetchall())
