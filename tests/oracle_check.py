"""Runs registered queries on Spark and their SQL on DuckDB and compares the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return str(value) if not isinstance(value, (int, float, str)) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    mine, my_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    theirs, their_names = _rows(names, cursor.fetchall())
    if my_names != their_names:
        return f"columns {my_names} against {their_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    gone = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(gone)} rows differ, first {gone[0]}" if gone else None


if __name__ == "__main__":
    from roadpulse.session import build_session

    session = build_session()
    folder = sys.argv[1]
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or list(entry.oracle_sql()):
        start = time.time()
        try:
            problem = compare(session, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = str(error)[:600]
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {problem or 'ok'}"[:700], flush=True)
    print("differing:", bad)
