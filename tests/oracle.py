"""Spark against DuckDB on the same tables, whatever the order of rows and columns."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def same(df, sql, con):
    assert rows(df.toPandas()) == rows(con.sql(sql).df())
