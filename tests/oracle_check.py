"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Comparison: same column names (sorted), same row count, same multiset of rows
after normalising values (timestamps to text, floats to 9 significant digits).

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return cols, out


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, con, name, fn, sql, sf_dir):
    scols, srows = rows_of_spark(fn(spark, sf_dir))
    dcols, drows = rows_of_duck(con, sql)
    problems = []
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duck={dcols}")
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    if not problems:
        cs, cd = Counter(srows), Counter(drows)
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            problems.append(f"values differ; spark-only {only_s} duck-only {only_d}")
    return len(srows), problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not os.path.isdir(a)]
    from calibra.session import build_session
    from calibra.registry import QUERIES
    from calibra.oracle import ORACLE
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        if name not in ORACLE:
            print(f"{name:28s} (no oracle)")
            continue
        try:
            n, problems = compare(spark, con, name, fn, ORACLE[name], sf_dir)
        except Exception as exc:  # report and continue
            n, problems = -1, [f"error: {str(exc)[:400]}"]
        bad += bool(problems)
        print(f"{name:28s} rows={n:6d} {'OK' if not problems else 'FAIL ' + ' | '.join(problems)}")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
