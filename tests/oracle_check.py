"""Run registered queries next to their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry_point
from reclattice.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = normalised(ours), normalised(theirs)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{(~same).sum()} values of {c} differ, first {a.loc[at].to_dict()} != {b.loc[at].to_dict()}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(os.environ.get("CHECK_CORES", "8")), duck(sf_dir)
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        t0 = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"{name:32s} rows-only {len(ours):8d}  {t1 - t0:6.1f}s", flush=True)
                continue
            problem = difference(ours, con.execute(oracles[name]).df())
        except Exception as error:  # a failing query is reported, the others still run
            problem, t1, ours = f"{type(error).__name__}: {str(error)[:1500]}", time.time(), ()
        failed += problem is not None
        print(f"{name:32s} {'ok' if problem is None else 'DIFFERS'} {len(ours):8d}  {t1 - t0:6.1f}s sql {time.time() - t1:5.1f}s  {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
