"""Run queries beside their SQL: python tests/verify_queries.py [--sf DIR] [NAME...]; prints what differs."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tributary.session import get_session  # noqa: E402


def shown(v):
    if isinstance(v, (list, dict, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(v)
    if v is None or pd.isna(v):
        return "NULL"
    if isinstance(v, (float, int)) or hasattr(v, "dtype") and v.dtype.kind in "fiu":
        return f"{float(v):.6f}"
    return str(v)


def canon(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple(shown(v) for v in row))
    return sorted(rows)


def main(args):
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.execution.pythonUDF.arrow.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), []
    for name in queries:
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        began = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
        except Exception as error:
            bad.append(name)
            print(name, "FAILED", str(error)[:1500])
            continue
        took = time.time() - began
        if name not in sql:
            print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL")
            continue
        try:
            want = con.execute(sql[name]).fetchdf()
        except Exception as error:
            bad.append(name)
            print(name, "SQL FAILED", str(error)[:600])
            continue
        a, b = canon(got), canon(want) if sorted(got.columns) == sorted(want.columns) else []
        if a == b:
            print(f"{name}: ok, {len(a)} rows, {took:.1f} s")
        else:
            bad.append(name)
            print(f"{name}: DIFFERS {len(a)} {len(want)} rows; columns {sorted(got.columns)} {sorted(want.columns)}")
            sa, sb = set(a), set(b)
            print("   spark", list(sa - sb)[:3], "\n   sql  ", list(sb - sa)[:3])
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
