"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/check.py [--sf 0.01] [--only name,name] [--data /root/testdata]
"""

from __future__ import annotations

import argparse
import decimal
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans.registry import all_queries, runner  # noqa: E402
from tidemark.plans.tables import TABLE_NAMES  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(int(value)) if value == value.to_integral_value() else str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--data", default="/root/testdata")
    args.add_argument("--only", default="")
    opts = args.parse_args()
    folder = f"{opts.data}/sf{opts.sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLE_NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    wanted = [n for n in opts.only.split(",") if n]
    bad = []
    for name, q in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = runner(q)(spark, folder)
            got = df.collect()
            spent = time.time() - start
            if q.sql is None:
                print(f"rows  {name:34s} {len(got):8d} rows {spent:6.2f}s (no SQL)")
                if not got:
                    bad.append(name)
                continue
            began = time.time()
            result = con.execute(q.sql)
            names = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            expected = result.fetchall()
            duck = time.time() - began
            problems = []
            if sorted(names) != sorted(df.columns):
                problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
            else:
                for c, kind in df.dtypes:
                    if FAMILY.get(kind, kind) != types[c]:
                        problems.append(f"type {c}: {kind} / {types[c]}")
                a, b = rows_of(df.columns, got), rows_of(names, expected)
                if a != b:
                    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
                    problems.append(f"{len(a)} / {len(b)} rows; only Spark {only_a}; only SQL {only_b}")
            if not got:
                problems.append("no rows")
            if any("rows" in p or "columns" in p for p in problems) or problems:
                bad.append(name)
            print(f"{'ok   ' if not problems else 'DIFF '} {name:34s} {len(got):8d} rows {spent:6.2f}s duck {duck:5.2f}s {'; '.join(problems)}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report tool shows every failure
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            if wanted:
                traceback.print_exc()
    print("problems:", ", ".join(bad) or "none")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
