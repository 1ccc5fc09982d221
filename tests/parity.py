"""Comparison of a query with its SQL: same columns, same rows, values as they are."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes edges works_base works_abstracts works_topics instance_mappings_hard instance_mappings_soft tail_to_head_candidates head_concepts eval_items manual_overrides head_selection_metrics works_raw".split()


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x.is_integer() and abs(x) < 1e15 else x
    if isinstance(x, Decimal):
        return _plain(float(x))
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(directory):
    import os

    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{directory}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def differences(spark, con, query, sql, directory):
    """Empty when equal, else a short account."""
    df = query(spark, directory)
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([x[0] for x in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if got != want:
        a, b = got - want, want - got
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list(a)[:3]}, only in SQL {list(b)[:3]}"
    return ""
