"""Comparison of registered queries with their oracle SQL.

Run as a script: python tests/compare.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return str(v)


def rows_of(columns: list[str], rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return collections.Counter(tuple(canonical(r[k]) for k in order) for r in rows)


def kind(t: str) -> str:
    """Coarse type of a column, the same names for both engines."""
    t = t.lower()
    if t in {"int", "integer", "bigint", "hugeint", "smallint", "tinyint", "long", "number"}:
        return "int"
    if t in {"double", "float"}:
        return "double"
    if t in {"string", "varchar"}:
        return "text"
    if t.startswith("decimal"):
        return "decimal" + t[t.index(",") :].replace(" ", "")
    return t.split("_")[0]


def compare(spark, con, query, sf_dir: str) -> dict:
    start = time.time()
    df = query.run(spark, sf_dir)
    rows = df.collect()
    out = {"name": query.name, "rows": len(rows), "sec": round(time.time() - start, 2), "types": dict(df.dtypes)}
    sql = query.oracle()
    if sql is None:
        return {**out, "status": "rows-only" if rows else "EMPTY"}
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_counter, want_counter = rows_of(df.columns, rows), rows_of(names, want)
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if got_counter != want_counter:
        problems.append(
            f"values: spark-only {sum((got_counter - want_counter).values())} {list((got_counter - want_counter))[:2]} "
            f"oracle-only {sum((want_counter - got_counter).values())} {list((want_counter - got_counter))[:2]}"
        )
    if not rows:
        problems.append("EMPTY")
    described = {r[0]: str(r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()}
    notes = [f"{c}: {t} / {described.get(c)}" for c, t in df.dtypes if kind(t) != kind(described.get(c, "?"))]
    plan = df._jdf.queryExecution().executedPlan().toString()
    notes += [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
    return {**out, "status": "ok" if not problems else "DIFF", "problems": problems, "notes": notes}


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from tallyspark import catalog
    from tallyspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    counts = collections.Counter()
    for name, q in catalog.load().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            r = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            r = {"name": name, "status": "ERROR", "problems": [f"{type(e).__name__}: {str(e)[:900]}"], "rows": 0, "sec": 0}
        counts[r["status"]] += 1
        print(f"{r['status']:9} {name:40} rows={r['rows']:<7} {r['sec']}s", flush=True)
        if r.get("notes"):
            print("      note:", "; ".join(r["notes"]))
        for p in r.get("problems", []):
            print("     ", p[:1500])
    print(dict(counts))
