"""Local twin check: run each registered Spark query and its DuckDB twin on the
same tables and compare row count, column names and values (order-insensitive).

usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from regscope.session import get_spark  # noqa: E402
from regscope.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", object()):
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, bool):
        return int(v)
    return v


# Python stages are allowed only where SURVEY §2.10 lists them (archives,
# segmentation, streaming state) and for the language scorer's matrix; no plan may hold a cartesian product.
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonMapInArrow", "MapInArrow",
                "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas")
PYTHON_OK = {"npm_members", "nupkg_members", "decode_text", "npm_ingest", "segmented_tokens", "language_gate"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_violations(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [n for n in FORBIDDEN if n in plan]
    if name not in PYTHON_OK:
        bad += [n for n in PYTHON_NODES if n in plan]
    return bad


def rows(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, out


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    # The registry queries; parts that can be taken out have tests of their own.
    from regscope.plans.catalog import QUERIES as qs, TWINS as tw
    spark = get_spark(cpus=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            q = qs[name](spark, sf_dir)
            pv = plan_violations(name, q)
            if pv:
                print(f"PLAN {name}: {pv}")
            sdf = q.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in tw:
            print(f"ROWS {name}: {len(sdf)} rows (no twin) {ts:.1f}s")
            continue
        try:
            ddf = con.execute(tw[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows(sdf)
        dc, dr = rows(ddf)
        if sc != dc:
            print(f"FAIL {name}: columns spark={sc} duck={dc}")
            bad += 1
        elif len(sr) != len(dr):
            print(f"FAIL {name}: rows spark={len(sr)} duck={len(dr)}")
            bad += 1
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows {ts:.1f}s")
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
