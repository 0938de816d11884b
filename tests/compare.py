"""Runs registered queries next to their SQL twins and compares the results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(f)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(row[c]) for c in cols) for row in df.collect()), df.dtypes


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(cell(row[i]) for i in order) for row in rel.fetchall())
    return [names[i] for i in order], rows, [(n, str(t)) for n, t in zip(names, rel.types)]


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def differences(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    sc, sr, st = spark_rows(df)
    dc, dr, dt = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    dtypes = dict(dt)
    bad = {n: (t, dtypes[n]) for n, t in st if TYPES.get(t, t) != dtypes[n]}
    if bad:
        return f"types {bad}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"values {dict(zip(sc, a))} vs {dict(zip(sc, b))}"
    return None


def main(argv):
    from obsweave.plans.session import local_session

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{argv[0]}"
    only = set(argv[1:])
    from obsweave.plans.session import tune

    spark = tune(local_session(8))
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                msg = differences(df, con, oracle[name])
                n = ""
            else:
                rows = df.collect()
                msg, n = None, f"rows-only {len(rows)} {rows[:2] if only else ''}"
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__} {str(e)[:1500]}", ""
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {name} {time.time() - t:.1f}s {n} {msg or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
