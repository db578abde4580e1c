"""Runs registered queries next to their SQL and compares the rows."""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    a = [tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t_spark = time.time() - t
    if sql is None:
        return True, f"rows {len(a)} (no SQL) spark {t_spark:.1f}s", a[:2]
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}", None
    ix = [names.index(c) for c in cols]
    b = [tuple(canon(r[i]) for i in ix) for r in cur.fetchall()]
    t_duck = time.time() - t
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a.sort(key=key)
    b.sort(key=key)
    msg = f"rows {len(a)} vs {len(b)} spark {t_spark:.1f}s duck {t_duck:.1f}s"
    if a == b:
        return True, msg, None
    sa, sb = set(a), set(b)
    return False, msg, (cols, sorted(sa - sb, key=key)[:3], sorted(sb - sa, key=key)[:3], len(sa - sb), len(sb - sa))


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from curbstream.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(folder)
    q, o = queries(), oracle_sql()
    names = sys.argv[1:] or list(q)
    bad = []
    for n in names:
        try:
            ok, msg, diff = compare(spark, con, q[n], o.get(n), folder)
        except Exception as e:
            ok, msg, diff = False, f"{type(e).__name__}: {str(e)[:900]}", None
        print("ok  " if ok else "FAIL", n, msg, "" if ok and n in o else diff, flush=True)
        if not ok:
            bad.append(n)
    print("bad:", bad)
