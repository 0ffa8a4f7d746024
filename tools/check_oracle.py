"""Runs registered queries and their check SQL side by side.

    python tools/check_oracle.py [--sf 0.01] [--only a,b] [--root /root/testdata]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwell.registry import REGISTRY  # noqa: E402
from panelwell.session import local_session, run_scope  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--root", default="/root/testdata")
    parser.add_argument("--only", default="")
    parser.add_argument("--skip", default="")
    args = parser.parse_args()
    sf_dir = f"{args.root}/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = args.only.split(",") if args.only else list(REGISTRY)
    bad = []
    for name in names:
        if name in args.skip.split(","):
            continue
        entry = REGISTRY[name]
        start = time.time()
        try:
            with run_scope(spark):
                df = entry.run(spark, sf_dir)
                rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if entry.sql is None:
                print(f"rows {name}: {len(rows)} ({took:.1f}s)", flush=True)
                continue
            db_start = time.time()
            result = db.execute(entry.sql)
            columns = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            expected = result.fetchall()
            db_took = time.time() - db_start
            problems = []
            if sorted(columns) != sorted(df.columns):
                problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
            else:
                mine = dict(df.dtypes)
                problems += [f"type {c}: {mine[c]} != {types[c]}" for c in columns if SPARK_TYPES.get(mine[c]) != types[c].replace("NUMBER", "BIGINT")]
                a, b = canonical(df.columns, rows), canonical(columns, expected)
                if len(a) != len(b):
                    problems.append(f"rows {len(a)} != {len(b)}")
                if a != b:
                    extra = [r for r in a if r not in set(b)][:2]
                    missing = [r for r in b if r not in set(a)][:2]
                    problems.append(f"values; only here {extra}; only in sql {missing}")
            print(f"{'ok  ' if not problems else 'BAD '} {name}: {len(rows)} ({took:.1f}s, sql {db_took:.1f}s)" + "".join(f"\n     {p}" for p in problems), flush=True)
            if problems:
                bad.append(name)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
    print(f"{len(bad)} bad: {','.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
