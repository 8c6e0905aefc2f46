"""Queries against their SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, datetime.date) else v


def same(spark, run, sql: str, folder: str = SF) -> None:
    got = run(spark, folder)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(([plain(r[c]) for c in order] for r in got.collect()), key=repr)
    truth = sorted(([plain(r[names.index(c)]) for c in order] for r in want.fetchall()), key=repr)
    assert len(rows) == len(truth)
    assert rows == truth
