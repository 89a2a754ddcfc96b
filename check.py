"""Run registered queries next to their DuckDB statements: ``python check.py [pattern ...] [--sf=0.01]``."""

import glob
import math
import os
import re
import sys
import time

import duckdb

from tidepanel.plans.catalog import QUERIES, STATEMENTS
from tidepanel.session import build_session


def norm(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return a == b


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    opts = dict(a[2:].split("=") for a in sys.argv[1:] if a.startswith("--"))
    sf_dir = f"/root/testdata/sf{opts.get('sf', '0.01')}"
    names = [n for n in QUERIES if not args or any(re.search(p, n) for p in args)]
    spark = build_session(master="local[8]", partitions=8)
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            cols = sorted(df.columns)
            got = [norm(r) for r in df.select(*cols).collect()]
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: spark: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in STATEMENTS:
            print(f"rows {name} {len(got)} {t1 - t0:.1f}s {got[:1]}", flush=True)
            continue
        try:
            rel = duck.execute(STATEMENTS[name])
            dcols = [d[0] for d in rel.description]
            order = [dcols.index(c) for c in cols]
            want = [norm(tuple(r[i] for i in order)) for r in rel.fetchall()]
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: duck: {str(e)[:1500]}", flush=True)
            continue
        t2 = time.time()
        key = lambda r: tuple((v is None, "" if v is None else str(v)) for v in r)
        got.sort(key=key)
        want.sort(key=key)
        exact = got == want
        if exact and len(got) > 0:
            print(f"ok   {name} {len(got)} {t1 - t0:.1f}s/{t2 - t1:.1f}s", flush=True)
            continue
        bad += 1
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        near = len(got) == len(want) and all(len(g) == len(w) and all(close(a, b) for a, b in zip(g, w)) for g, w in diff)
        sg, sw = set(got), set(want)
        og, ow = [g for g in got if g not in sw], [w for w in want if w not in sg]
        print(f"DIFF {name} rows {len(got)}/{len(want)} differing {len(og)}/{len(ow)} near={near} {t1 - t0:.1f}s cols={cols}", flush=True)
        for g in og[:3]:
            print("   spark", g)
        for w in ow[:3]:
            print("   duck ", w)
    print(f"{len(names)} queries, {bad} bad")


main()
