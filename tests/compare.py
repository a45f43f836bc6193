"""Rows of a query and of its SQL, brought to one form and compared."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value + 0.0, 6)
    return value


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in rows)


def sql_rows(sf_dir: str, sql: str):
    with duckdb.connect() as db:
        for f in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        return names, found.fetchall()


def differences(df, sf_dir: str, sql: str):
    names, rows = sql_rows(sf_dir, sql)
    mine = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = lines(df.columns, mine), lines(names, rows)
    return [] if a == b else [(len(a), len(b)), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]]
