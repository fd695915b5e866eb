"""Results of queries against those of their SQL."""

import math
import os
from datetime import datetime

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(sorted(value.items())) if isinstance(value, dict) else value


def same(spark, sf, query, sql) -> int:
    """How many rows there are; raises if columns or rows differ."""
    frame = query(spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[k]) for k in places) for r in answer.fetchall()), key=str)
    assert got == want
    return len(got)
