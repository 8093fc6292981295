"""Compares a Spark query with its DuckDB SQL on the same tables: names, rows, values; order does not matter."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def same(df, sql, folder=SMALL):
    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs, ours = rows_of(names, got.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
