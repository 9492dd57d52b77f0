"""Run queries next to their SQL and compare whole results: python tests/compare.py sf0.01 [names]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5f}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, list):
        return str([_plain(e) for e in x])
    return str(x)


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same rows, otherwise a short description."""
    mine_cols = sorted(df.columns)
    mine = Counter(tuple(_plain(r[c]) for c in mine_cols) for r in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != mine_cols:
        return f"columns {mine_cols} against {sorted(cols)}"
    order = [cols.index(c) for c in mine_cols]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in rel.fetchall())
    if mine == theirs:
        return None
    only, missing = mine - theirs, theirs - mine
    return f"rows {sum(mine.values())} against {sum(theirs.values())}; only here {str(list(only)[:2])[:600]}; missing {str(list(missing)[:2])[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from redpen.session import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(e.queries())
    spark, con = build_session(spark__ui__showConsoleProgress="false"), connect(sf)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = e.queries()[name](spark, sf)
            sql = e.oracle_sql().get(name)
            verdict = f"rows only: {df.count()}" if sql is None else difference(df, con, sql)
        except Exception as x:  # noqa: BLE001
            verdict = f"ERROR {type(x).__name__}: {str(x)[:900]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {verdict or ''}", flush=True)
    print("failures:", bad)
