"""Spark rows against DuckDB rows."""

import math

from conftest import SF


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def agree(spark, duck, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want
