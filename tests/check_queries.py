"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf_dir] [name part ...]``."""
from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import LAST, compare, connect  # noqa: E402
from shelfgrade.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    con = connect(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(a in n or getattr(entry.base.QUERIES.get(n), '__module__', '').endswith('.' + a) for a in args)]
    bad = 0
    for n in names:
        start = time.time()
        try:
            if n in sql:
                diff = compare(qs[n](spark, sf), sql[n], con)
            else:
                diff = None if qs[n](spark, sf).count() > 0 else "EMPTY"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        took = time.time() - start
        spark_s = LAST.get("spark", took) if n in sql else took
        if diff or spark_s > 4:
            print(f"{'FAIL' if diff else 'slow'} {n} {took:.1f}s (spark {spark_s:.1f}s) {diff or ''}", flush=True)
        bad += bool(diff)
    print(f"{len(names)} queries, {len([n for n in names if n in sql])} with SQL, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
