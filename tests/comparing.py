"""Order-free comparison of two results."""

from __future__ import annotations

import datetime as dt
import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def agree(query, sql, spark, duck, data):
    mine = query(spark, data)
    theirs = duck.sql(sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())
