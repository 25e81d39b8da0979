"""Compare registered queries with their SQL in DuckDB, as sets of rows with multiplicity."""

from __future__ import annotations

import math
import os
from collections import Counter
from typing import Any

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if they agree."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    frame = query(spark, sf_dir)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(frame.columns):
        return f"{name}: columns {sorted(frame.columns)} and {sorted(columns)}"
    ours, theirs = rows_of(frame.columns, [tuple(r) for r in frame.collect()]), rows_of(columns, found.fetchall())
    if ours != theirs:
        return f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows; {list((ours - theirs).items())[:3]} and {list((theirs - ours).items())[:3]}"
    return ""
