"""Side-by-side run of a registered query and its check SQL."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


def compare(spark, con, name, query, oracle, sf_dir):
    """Returns None when equal, else a text that says what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        gs, ws = {str(r) for r in got}, {str(r) for r in want}
        return f"rows {len(got)} != {len(want)}; only spark {sorted(gs - ws)[:2]}; only sql {sorted(ws - gs)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"row differs\n  spark {g}\n  sql   {w}"
    if not got:
        return "EMPTY on both sides"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import importlib.util

    from corpuslens.session import local_session

    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    q, o = m.queries(), m.oracle_sql()
    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, con = local_session(8), duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in o:
                r = compare(spark, con, n, q[n], o[n], sf)
            else:
                r = None if q[n](spark, sf).count() else "EMPTY (no oracle)"
        except Exception as e:  # noqa: BLE001
            r = "ERROR " + str(e)[:900]
        bad += r is not None
        print(f"{'ok  ' if r is None else 'FAIL'} {n} {time.time() - t:.1f}s {r or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
