"""Every registered query against its DuckDB twin on the smallest tables."""

import os
import subprocess
import sys



ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_contract(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    qs, tw = E.queries(), E.oracle_sql()
    assert set(tw) <= set(qs)
    assert len(qs) >= 60


def test_all_twins_sf0001():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "scripts", "check_oracle.py"), "/root/testdata/sf0.001"],
                         capture_output=True, text=True, timeout=1800, cwd=ROOT)
    lines = [l for l in out.stdout.splitlines() if l.startswith(("OK", "FAIL", "ROWS"))]
    fails = [l for l in lines if l.startswith("FAIL")]
    plans = [l for l in out.stdout.splitlines() if l.startswith("PLAN")]
    assert lines and not fails, "\n".join(fails)
    assert not plans, "\n".join(plans)


def test_entry_smoke(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 200 and set(df.columns) == {"package_id", "name", "result", "author"}
    assert {r.result for r in rows} <= {"null", "no_overview", "overview_no_link", "non-abuse", "abuse"}
