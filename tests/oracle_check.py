"""Run registered queries beside their DuckDB SQL and compare every value.

    python -m tests.oracle_check [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path

import duckdb

ROOT = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} but oracle {want_names}"
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return (f"{len(got)} rows but oracle {len(want)}; {len(extra)} extra, {len(missing)} missing\n"
                f"   spark  {extra[:2]}\n   oracle {missing[:2]}")
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from __spark_entry__ import oracle_sql, queries
    from talkmine.session import local_session

    spark, sf_dir = local_session("8"), f"{ROOT}/sf{args.sf}"
    con, oracles, bad = duck(sf_dir), oracle_sql(), 0
    todo = {n: q for n, q in queries().items() if not args.names or any(a in n for a in args.names)}
    for name, run in todo.items():
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem, note = compare(df, con, oracles[name]), "exact"
            else:
                problem, note = None, f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s "
              f"{note if problem is None else problem}", flush=True)
    print(f"{len(todo) - bad} of {len(todo)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
