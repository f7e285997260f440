"""Compare a Spark result with its SQL restatement, regardless of row and column order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# Spark type names and what the other side calls them.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    odd = {n: (t, types[n]) for n, t in df.dtypes if TYPES.get(t, t) != types[n]}
    if odd:
        return f"types {odd}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if ours == theirs:
        return None
    more, less = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {len(more)}: {more[:2]}; only theirs {len(less)}: {less[:2]}"
