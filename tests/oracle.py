"""Compare a query with its SQL on the same tables, row by row in any order."""

import glob
import os

import duckdb


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).map(_plain).itertuples(index=False, name=None)))


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v):
        return int(v)
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db.sql(sql).df()
