"""Run registered queries against their DuckDB oracle: python tests/run_oracle.py [sf_dir] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from compare import compare, duck, type_mismatches  # noqa: E402
from stagewatch.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("ORACLE_SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_SESSION_TZ"])
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    items = list(qs.items())
    if os.environ.get("ORACLE_SHUFFLE"):
        import random

        random.Random(int(os.environ["ORACLE_SHUFFLE"])).shuffle(items)
    for name, fn in items:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in orc:
                ok, msg = compare(df, con, orc[name])
                tm = type_mismatches(df, con, orc[name])
                if tm:
                    msg += f" | TYPES {tm}"
            else:
                ok, msg = True, f"{df.count()} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:40s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(qs)} queries, {len(orc)} with oracle, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
