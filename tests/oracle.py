"""Compare registered queries with DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder: str):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def _close(a: Counter, b: Counter) -> bool:
    """Same rows but for the last rounded digit, which two engines may settle differently on a tie."""

    def key(row):
        return [(str(type(v)), "" if isinstance(v, float) else str(v)) for v in row] + [v for v in row if isinstance(v, float)]

    x, y = sorted(a.elements(), key=key), sorted(b.elements(), key=key)
    return len(x) == len(y) and all(
        u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1.01e-4) for r, q in zip(x, y) for u, v in zip(r, q)
    )


def compare(df, con, sql: str, tolerant: bool = False) -> str:
    """Empty text if both sides agree on names, rows and values, else what differs."""
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = _rows(want_cols, cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if got != want:
        a, b = got - want, want - got
        if tolerant and _close(a, b):
            return ""
        return f"{sum(got.values())} rows vs {sum(want.values())}; only spark {sum(a.values())}: {list(a)[:3]}; only sql {sum(b.values())}: {list(b)[:3]}"
    return "" if got else "both empty"


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            said = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        ok = not said or said.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
