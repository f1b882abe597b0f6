"""python -m tests.check [sf] [key ...]: run registered queries against their SQL twins."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as e
from tests.oracle import connect, difference
from tests.session import make_session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    wanted = sys.argv[2:] or list(qs)
    bad = 0
    for key in wanted:
        start = time.time()
        try:
            df = qs[key](spark, sf_dir)
            if key in sqls:
                problem = difference(df, con, sqls[key])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                key += f" (rows only: {n})"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {key} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
