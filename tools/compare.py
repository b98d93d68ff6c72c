"""Run registered queries next to their SQL twins and report every difference.

    python tools/compare.py [data folder] [query name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from stoopwise.catalog import all_queries  # noqa: E402
from stoopwise.catalog.registry import TABLES  # noqa: E402
from stoopwise.session import local_session  # noqa: E402


def normal(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, bool):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def twin(connection, sql):
    found = connection.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def connect(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    known = all_queries()
    names = argv[1:] or list(known)
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = []
    for name in names:
        query = known[name]
        try:
            start = time.time()
            df = query.run(spark, folder)
            mine = (df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if query.sql is None:
                print(f"ROWS  {name} {len(mine[1])} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            other = twin(connection, query.sql)
            theirs = time.time() - start
            same_columns = sorted(mine[0]) == sorted(other[0])
            a, b = rows_of(*mine), rows_of(*other)
            if same_columns and a == b:
                print(f"OK    {name} {len(a)} rows {took:.1f}s / {theirs:.1f}s", flush=True)
                continue
            bad.append(name)
            print(f"DIFF  {name} {len(a)} vs {len(b)} rows", sorted(mine[0]), sorted(other[0]))
            left, right = set(a), set(b)
            print("  only spark:", str(sorted(left - right, key=str)[:3])[:700])
            print("  only sql:  ", str(sorted(right - left, key=str)[:3])[:700], flush=True)
        except Exception:
            bad.append(name)
            print(f"FAIL  {name}", flush=True)
            print("  " + traceback.format_exc(limit=-3).replace("\n", "\n  ")[:1800], flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
