"""Compare registered queries with their SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(canonical(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cur.fetchall())
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (name, len(bad), bad[:3])
    return len(got)
