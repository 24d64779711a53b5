"""Compares queries with their SQL, or only counts rows: python tests/compare.py [--sf DIR] NAME..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

import __spark_entry__ as E
from skein.runtime import local_session


def canon(pdf: pd.DataFrame) -> list:
    def norm(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if hasattr(v, "tolist"):
            return str([norm(x) for x in v.tolist()])
        if isinstance(v, list):
            return str([norm(x) for x in v])
        if v is None or v is pd.NaT:
            return None
        if isinstance(v, bool):
            return v
        if hasattr(v, "item"):
            v = v.item()
            return norm(v) if isinstance(v, float) else v
        return v

    cols = sorted(pdf.columns)
    rows = [tuple(norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def same(name: str, spark, d: str, con) -> tuple[bool, str]:
    t = time.time()
    got = E.queries()[name](spark, d).toPandas()
    took = time.time() - t
    sql = E.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return False, f"{name}: {len(a)} against {len(b)} rows; first difference {first}"
    return True, f"{name}: ok, {len(a)} rows, {took:.1f} s"


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return con


if __name__ == "__main__":
    args = sys.argv[1:]
    d = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = args[1], args[2:]
    spark, con = local_session(), connect(d)
    for name in args or E.queries():
        try:
            print(same(name, spark, d, con)[1], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: {type(e).__name__} {str(e)[:600]}", flush=True)
