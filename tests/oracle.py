"""Holding a DataFrame against SQL that DuckDB runs on the same tables."""

import os
from collections import Counter

import duckdb


def rows(df, columns):
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else str(v) if not isinstance(v, (int, str, bool)) else v for v in r))
    return Counter(out)


def same(got, sql, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        c.sql(f"CREATE VIEW {f[:-8]} AS FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {f[:-8]} AS FROM read_parquet('{p}')")
    a, b = got.toPandas(), c.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None) for x in (a, b))
    assert rows(a, cols) == rows(b, cols)
