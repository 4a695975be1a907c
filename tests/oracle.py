"""Run a registered query and its SQL twin and compare them row by row."""

from __future__ import annotations

import datetime as dt
import math
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x).__name__ in ("str",)), str(x)) for x in t))
    return [names[i] for i in order], out


def compare(df, con, sql) -> tuple[str, str]:
    """('ok' | reason, timing)"""
    t0 = time.time()
    names, got = _rows(df.columns, df.collect())
    t1 = time.time()
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    timing = f"spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s rows {len(got)}"
    if names != want_names:
        return f"columns {names} != {want_names}", timing
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", timing
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[:2]}", timing
    return "ok", timing
