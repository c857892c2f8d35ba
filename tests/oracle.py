"""Compare registered queries with their SQL on DuckDB: `python tests/oracle.py [sf] [prefix ...]`."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v.normalize()}"
    if isinstance(v, float):
        return "\0null" if math.isnan(v) else f"f:{v + 0.0!r}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, dt.datetime):
        return f"t:{v.isoformat()}"
    if isinstance(v, dt.date):
        return f"y:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"s:{v}"


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_c, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_c, want = table_rows([d[0] for d in rel.description], rel.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}\n  only spark {[x for x in got if x not in want][:3]}\n  only sql {[x for x in want if x not in got][:3]}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"values differ in {len(a)} of {len(got)} rows {got_c}\n  spark {sorted(a)[:3]}\n  sql   {sorted(b)[:3]}"
    return f"ok {len(got)}" if got else "EMPTY"


def main(argv):
    import __spark_entry__ as entry

    from tallygrove.session import get_spark

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            if name in oracle:
                res = compare(spark, con, fn, oracle[name], sf_dir)
            else:
                res = f"rows-only {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {str(e)[:700]}"
        ok = res.startswith(("ok", "rows-only"))
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:40s} {time.time() - t:6.2f}s {res}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
