"""Results of queries beside those of their SQL in DuckDB."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    """Values that compare alike whatever engine they are from."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(rows, names) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def by_sql(sql: str, folder: str):
    """Names and rows of a query over the tables of a folder."""
    with duckdb.connect() as db:
        db.execute("set TimeZone = 'UTC'")
        for path in Path(folder).glob("*.parquet"):
            db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
        found = db.execute(sql)
        return [c[0] for c in found.description], found.fetchall()


def check(df, sql: str, folder: str) -> int:
    """The rows of `df`, which must be those of `sql`; how many they are."""
    names, expected = by_sql(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.collect(), df.columns)
    assert got == rows_of(expected, names)
    return len(got)
