"""Run every registered query in Spark and its DuckDB oracle on the same
parquet tables; compare column names, row counts and values (order-free).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


# Spark type -> DuckDB type name, for the schema part of the comparison.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
              "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(rows), sec=round(t1 - t0, 2), note="rows only")
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows_raw = cur.fetchall()
    if sorted(dcols) != sorted(cols):
        return dict(name=name, ok=False, note=f"columns {sorted(cols)} vs {sorted(dcols)}")
    duck_types = dict(zip(dcols, [str(t) for t in con.sql(sql).types]))
    wrong = {c: (t, duck_types.get(c)) for c, t in spark_types.items()
             if TYPE_NAMES.get(t, t) != duck_types.get(c)}
    if wrong:
        return dict(name=name, ok=False, note=f"types {wrong}")
    idx = {c: i for i, c in enumerate(dcols)}
    drows = [tuple(norm(r[idx[c]]) for c in sorted(cols)) for r in drows_raw]
    a, b = Counter(rows), Counter(drows)
    ok = a == b
    note = ""
    if not ok:
        only_s = list((a - b).elements())[:2]
        only_d = list((b - a).elements())[:2]
        note = f"spark-only {len(list((a - b).elements()))}: {only_s!r:.600} | duck-only: {only_d!r:.600}"
    return dict(name=name, ok=ok, rows=len(rows), drows=len(drows), sec=round(t1 - t0, 2), note=note)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from quizlens.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            res = compare(spark, con, name, fn, ors.get(name), sf_dir)
        except Exception as ex:  # report and go on
            res = dict(name=name, ok=False, note=f"{type(ex).__name__}: {str(ex)[:400]}")
        bad += res["ok"] is False
        print(res, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
