"""Run registered queries next to their DuckDB SQL and compare all rows.

    python tests/oracle_check.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, build, check):
    """None when equal, else what differs; and the row count."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if check is None:
        return (None if got else "no rows"), len(got)
    cur = con.execute(check)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}", len(got)
    want = rows_of(names, cur.fetchall())
    if len(got) != len(want):
        return f"rows spark {len(got)} duckdb {len(want)}", len(got)
    if not got:
        return "no rows", 0
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} / {bad[0][1]} of {sorted(names)}", len(got)
    off = [f"{c}: {t} / {kinds[c]}" for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]]
    return (f"types {off}" if off else None), len(got)


def main(argv):
    import __spark_entry__ as entry
    from stationcast.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark, con = local_session(8), connect(sf_dir)
    checks = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            problem, rows = compare(spark, con, sf_dir, build, checks.get(name))
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:400]}", 0
        failed += problem is not None
        kind = "oracle" if name in checks else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:34} {kind:6} {rows:7} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
