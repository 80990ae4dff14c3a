"""Runs a registered query and its SQL over one data folder and compares the rows, whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, bool):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())


def duck_rows(sql: str, folder: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_cell(r[i]) for i in order) for r in got.fetchall())


def difference(df, sql: str, folder: str) -> str:
    names, want = duck_rows(sql, folder)
    assert sorted(df.columns) == names, f"{sorted(df.columns)} != {names}"
    got = spark_rows(df)
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only in Spark {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
