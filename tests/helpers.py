"""DuckDB comparison: rows as sorted tuples of their columns by name."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(df):
    names = sorted(df.columns)
    values = df[names].astype(object).where(df[names].notna(), None).values.tolist()
    return sorted(repr([plain(v) for v in r]) for r in values)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c
