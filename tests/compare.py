"""Compare a registered query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    if columns != sorted(names):
        return f"columns {columns} and {sorted(names)}"
    wanted = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=_key)
    found = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_key)
    if len(wanted) != len(found):
        extra = [r for r in found if r not in wanted][:2] if len(found) < 5000 else []
        return f"{len(found)} rows, SQL {len(wanted)}; only here: {str(extra)[:600]}"
    for a, b in zip(found, wanted):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y][:2]
            return f"{columns}: {str(bad)[:1200]} in {str(a)[:200]}"
        if any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"types of {a} and {b}"
    return None if wanted else "no rows"
