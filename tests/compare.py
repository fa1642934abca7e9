"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    got_cols, got = df.columns, df.collect()
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"spark {str(x)[:1500]}\n   sql {str(y)[:1500]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from lorebase.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    conf["spark.sql.shuffle.partitions"] = os.environ.get("PARTITIONS", "8")
    spark = build_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        df = fn(spark, sf_dir)
        if name in oracles:
            diff = difference(df, con, oracles[name])
            status = "ok" if diff is None else f"DIFF {diff}"
            bad += diff is not None
        else:
            status = f"rows only: {df.count()}"
        print(f"{name:28s} {time.time() - start:6.2f}s {status}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
