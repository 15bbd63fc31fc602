"""Runs registered queries beside their SQL: python tests/parity.py [-d FOLDER] [NAME...]."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def normal(pdf):
    pdf = pdf.copy()
    pdf.columns = [str(c) for c in pdf.columns]
    pdf = pdf[sorted(pdf.columns)]

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        if isinstance(v, bool):
            return str(v)
        try:
            if v is pd.NA:
                return "~"
            if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
                return f"{float(v) + 0.0:.9g}"
        except TypeError:
            pass
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def compare(spark, con, name, f, sql, folder):
    got = f(spark, folder).toPandas()
    if sql is None:
        return len(got), None, None
    want = con.execute(sql).df()
    if sorted(map(str, got.columns)) != sorted(map(str, want.columns)):
        return len(got), len(want), f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return len(got), len(want), ""
    sa, sb = set(a), set(b)
    return len(got), len(want), f"only spark {list(sa - sb)[:3]} only sql {list(sb - sa)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from grovekit.session import local_session

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        folder, args = args[1], args[2:]
    spark, con = local_session(cores="8"), views(folder)
    sql = e.oracle_sql()
    bad = 0
    for name, f in e.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            n, m, why = compare(spark, con, name, f, sql.get(name), folder)
        except Exception as x:
            n, m, why = None, None, f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '}{name} {n} {'-' if m is None else m} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("bad:", bad)
