"""Run registered queries against their SQL twins: python tests/oracle.py [folder] [key-prefix ...]"""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LIMIT = int(os.environ.get("ORACLE_LIMIT", "90"))


def _late(*_):
    raise TimeoutError(f"over {LIMIT} s")


signal.signal(signal.SIGALRM, _late)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def kind(v):
    return type(v).__name__


def compare(spark, con, folder, key, fn, sql):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, folder)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return bool(got), f"rows={len(got)} (no SQL) {took:.2f}s"
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} != {sorted(want_cols)}"
    a, b = rows_of(cols, got), rows_of(want_cols, want)
    note = ""
    types_a = {c: {kind(r[i]) for r in got[:500]} - {"NoneType"} for i, c in enumerate(cols)}
    types_b = {c: {kind(r[i]) for r in want[:500]} - {"NoneType"} for i, c in enumerate(want_cols)}
    for c in cols:
        if types_a[c] and types_b[c] and types_a[c] != types_b[c]:
            note += f" TYPE {c}: {types_a[c]} vs {types_b[c]}"
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"rows {len(got)} vs {len(want)}; cols {sorted(cols)}\n   spark {only_a}\n   twin  {only_b}{note}"
    return not note, f"rows={len(got)} {took:.2f}s{note}"


def main():
    import __spark_entry__ as entry
    from modiste.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_session("oracle", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for key, fn in qs.items():
        if prefixes and not any(key == p or (p.endswith("*") and key.startswith(p[:-1])) for p in prefixes):
            continue
        signal.alarm(LIMIT)
        try:
            ok, msg = compare(spark, con, folder, key, fn, sqls.get(key))
        except Exception as ex:  # report and go on to the next key
            ok, msg = False, f"{type(ex).__name__}: {str(ex).strip()[-500:]}"
            spark.sparkContext.cancelAllJobs()
        finally:
            signal.alarm(0)
        if not ok:
            bad.append(key)
        if not ok or not ({"-q"} & set(prefixes)):
            print("ok  " if ok else "FAIL", key, msg, flush=True)
    print(len(qs), "queries,", len(sqls), "twins, failing:", bad)


if __name__ == "__main__":
    main()
