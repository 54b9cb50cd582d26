"""Compares the text queries that have SQL with DuckDB: python tests/llm/oracle.py [sf_dir] [prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import duckdb

from tests.oracle_check import compare


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> None:
    from ridelattice.llm.queries import ORACLES, QUERIES
    from ridelattice.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("llm-oracles")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        t, df = time.time(), fn(spark, sf_dir)
        said = compare(df, duck(sf_dir), ORACLES[name]) or "ok" if name in ORACLES else f"rows {df.count()}"
        print(f"{time.time() - t:6.1f}s {name}: {said}", flush=True)


if __name__ == "__main__":
    main()
