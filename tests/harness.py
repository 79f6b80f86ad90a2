"""Run a registered query and its SQL side by side, as sorted rows of plain values."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = duck(sf_dir).sql(sql)
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    return rows(df.columns, got), rows(rel.columns, want)
