"""A query's rows against its SQL in DuckDB, as sorted tuples of values by column name."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def view(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(data).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)


def difference(df, con, sql: str) -> str:
    (a, x), (b, y) = rows_of_spark(df), rows_of_sql(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        one, two = set(map(repr, x)) - set(map(repr, y)), set(map(repr, y)) - set(map(repr, x))
        return f"{len(x)} and {len(y)} rows; only Spark {len(one)}: {sorted(one)[:2]}; only SQL {len(two)}: {sorted(two)[:2]}"
    return ""
