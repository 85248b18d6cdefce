"""Run registered queries beside their SQL on the given tables and compare the rows.

``python tests/oracle_check.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(value):
    """A comparable form of a cell."""
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(normal(v) for v in row) for row in frame.itertuples(index=False))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, func, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    got = func(spark, sf_dir).toPandas()
    spent = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    started = time.time()
    want = con.execute(sql).df()
    note = f"{len(got)} rows, {spent:.1f}s, sql {time.time() - started:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    left, right = rows_of(got), rows_of(want)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return False, f"{note}; spark {len(left)} sql {len(right)}; spark only {only_left}; sql only {only_right}"
    return True, note


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry_module
    from bench import session

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = session(), connect(sf_dir), 0
    found, oracles = entry_module.queries(), entry_module.oracle_sql()
    for name, func in found.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, func, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
