"""Compare registered queries with their SQL on the same Parquet tables.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from ridelattice.sources.fixtures import BASE_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql, clock=None):
    """None when equal, else a short description of the first difference."""
    a_cols, a = normalise(df.columns, [tuple(r) for r in df.collect()])
    if clock is not None:
        clock.append(time.time())
    cur = con.execute(sql)
    b_cols, b = normalise([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}"
    if len(a) != len(b):
        only = list(set(a) ^ set(b))[:4]
        return f"rows {len(a)} vs {len(b)}; e.g. {only}"
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return f"{len(left)} of {len(a)} rows differ; spark {sorted(left)[:3]} sql {sorted(right)[:3]}"
    return None


def main() -> int:
    from ridelattice.plans.catalog import ORACLES, QUERIES
    from ridelattice.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                clock = []
                diff = compare(df, con, ORACLES[name], clock)
                n = f"ok (spark {clock[0]-t:.1f}s, {len(df.columns)} cols)"
                if diff:
                    n = "DIFF " + diff
            else:
                n = f"rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            n = "ERROR " + str(e)[:500]
        bad += n.startswith(("DIFF", "ERROR"))
        print(f"{time.time()-t:6.1f}s {name}: {n}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
