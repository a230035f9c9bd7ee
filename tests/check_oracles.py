"""Compare every registered query with its SQL on the same tables: rows, columns and values.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from mirrorframe.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r)), [columns[i] for i in order]


def differences(spark_columns, spark_rows, sql_columns, sql_rows):
    left, left_columns = rows_of(spark_columns, spark_rows)
    right, right_columns = rows_of(sql_columns, sql_rows)
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right, strict=True):
        for name, x, y in zip(left_columns, a, b, strict=True):
            if kind(x) != kind(y):
                return f"{name}: {x!r} / {y!r}"
            if isinstance(x, float) and math.isnan(x) and math.isnan(y):
                continue
            if x != y:
                return f"{name}: {x!r} / {y!r} in {a} / {b}"
    return None


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    failed = []
    for name in wanted:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name:28} {took:6.2f}s rows={len(rows)}", flush=True)
                continue
            cursor = con.execute(oracles[name])
            problem = differences(df.columns, rows, [c[0] for c in cursor.description], cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            took, rows, problem = time.time() - started, [], f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL ' if problem else 'ok   '} {name:28} {took:6.2f}s rows={len(rows)} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
