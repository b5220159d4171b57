"""Compare registered queries with their SQL on DuckDB:  python tests/oracle.py [folder] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.01"


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    got = fn(spark, folder)
    got_rows = rows_of(got.columns, got.collect())
    if sql is None:
        return None, len(got_rows), "rows only"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want_rows = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(got.columns):
        return False, len(got_rows), f"columns {sorted(got.columns)} != {sorted(cols)}"
    kinds = {str(c[0]): str(c[1]) for c in rel.description}
    huge = [c for c, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]
    if huge:
        return False, len(got_rows), f"wide SQL types in {huge}"
    if got_rows != want_rows:
        have, want = set(got_rows), set(want_rows)
        extra, lack = sorted(have - want, key=repr)[:2], sorted(want - have, key=repr)[:2]
        return False, len(got_rows), f"rows {len(got_rows)} vs {len(want_rows)}; spark {extra} sql {lack}"
    return True, len(got_rows), "ok"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else FOLDER
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            ok, n, note = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, n, note = False, 0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += ok is False
        print(f"{'OK ' if ok else 'ROW' if ok is None else 'BAD'} {name:34s} {n:7d} rows {time.time()-t0:6.2f}s  "
              f"{'' if ok else note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
