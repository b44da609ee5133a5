"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        f = float(v)
        return None if f != f else round(f, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def differs(a, b, tol):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) > tol * max(1.0, abs(a), abs(b))
    return a != b


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql, tol=0.0):
    """None when equal, else a description."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    c1, r1 = table_of(df.columns, rows)
    if sql is None:
        return None, len(r1)
    cur = con.execute(sql)
    c2, r2 = table_of([d[0] for d in cur.description], cur.fetchall())
    if c1 != c2:
        return f"columns {c1} != {c2}", len(r1)
    if len(r1) != len(r2):
        only1, only2 = [r for r in r1 if r not in set(r2)][:3], [r for r in r2 if r not in set(r1)][:3]
        return f"rows {len(r1)} != {len(r2)}\n   spark {only1}\n   sql   {only2}", len(r1)
    bad = [(x, y) for x, y in zip(r1, r2) if any(differs(a, b, tol) for a, b in zip(x, y))]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ; columns {c1}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(r1)
    return None, len(r1)


def main():
    import __spark_entry__ as entry
    from tickloom.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args[1:] or any(p in n for p in args[1:])]
    failed = []
    for n in names:
        t = time.time()
        try:
            err, rows = compare(spark, con, sf, queries[n], oracles.get(n))
        except Exception as e:  # report and go on with the next query
            err, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
        status = "ok " if err is None else "BAD"
        print(f"{status} {n:34s} rows={rows:<7d} {time.time() - t:6.2f}s {'' if n in oracles else '(no sql)'}", flush=True)
        if err:
            print("   ", err, flush=True)
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
