"""Compare registered queries with their SQL on DuckDB: python check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from headway.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([cell(x) for x in v])
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        try:
            f = float(v)
            return f"{f:.6f}" if f != int(f) else str(int(f))
        except (TypeError, ValueError, OverflowError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def main(folder: str, names: list[str]) -> int:
    from headway.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{folder}/{x}.parquet'")
    spark = local_session()
    bad, slow = [], []
    for n in names or sorted(QUERIES):
        try:
            t0 = time.time()
            got = QUERIES[n](spark, folder).toPandas()
            took = time.time() - t0
            slow.append((took, n))
            if n not in ORACLES:
                print(f"rows  {n} {len(got)} {took:.1f}s", flush=True)
                continue
            want = con.execute(ORACLES[n]).df()
            a, b = norm(got), norm(want)
            if sorted(got.columns) != sorted(want.columns):
                raise AssertionError(f"columns {sorted(got.columns)} != {sorted(want.columns)}")
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                raise AssertionError(f"{len(a)} vs {len(b)} rows; {sorted(got.columns)}; {diff}")
            print(f"ok    {n} {len(got)} {took:.1f}s" + ("  EMPTY" if not len(got) else ""), flush=True)
        except Exception as e:
            bad.append(n)
            print(f"FAIL  {n}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    print("slowest:", sorted(slow, reverse=True)[:12])
    return len(bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
