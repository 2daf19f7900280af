"""Run registered queries next to their check SQL."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else ("nan" if math.isnan(v) else v)
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def compare(spark, con, sf_dir, name, fn, sql):
    """Empty string when equal, else a description of the difference."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    times = f"[{len(rows)} rows, spark {t1-t0:.1f}s, check {t2-t1:.1f}s]"
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)} {times}", times
    order = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in order) for r in want]
    if len(rows) != len(want):
        return f"row count {len(rows)} != {len(want)} {times}", times
    a, b = sorted(rows, key=_key), sorted(want, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, columns {cols}: {bad[:3]} {times}", times
    types = [type(v).__name__ for v in (a[0] if a else ())], [type(v).__name__ for v in (b[0] if b else ())]
    if types[0] != types[1]:
        return f"types {types} {times}", times
    return "", times


if __name__ == "__main__":
    import os
    import sys
    import traceback

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from chromatile.session import local_session
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    qs, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in qs.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            if name in oracle:
                msg, times = compare(spark, con, sf, name, fn, oracle[name])
            else:
                t0 = time.time()
                n = fn(spark, sf).count()
                msg, times = "", f"[rows only {n}, {time.time()-t0:.1f}s]"
        except Exception as e:
            msg = "ERROR " + str(e).split("\n\n")[0][:1500] + traceback.format_exc()[-700:]
            times = ""
        print(("ok  " if not msg else "BAD ") + name, msg[:2500] or times, flush=True)
        if msg:
            failed.append(name)
    print("failed:", failed)
