"""Spark results against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return repr(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
