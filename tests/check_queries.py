"""python tests/check_queries.py [SF_DIR] NAME...: run queries and compare them with their SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from auditloom.session import local_session  # noqa: E402
from tests.oracle import compare  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    found, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or found:
        t = time.time()
        try:
            if name in sqls:
                n, diff = compare(found[name](spark, sf), sqls[name], sf)
            else:
                n, diff = found[name](spark, sf).count(), []
            print(("ok  " if not diff else "DIFF"), name, n, "sql" if name in sqls else "rows only", f"{time.time() - t:.1f}s", *diff, sep="  ", flush=True)
            bad += bool(diff)
        except Exception as e:
            bad += 1
            print("FAIL", name, str(e)[:900], flush=True)
    sys.exit(bad > 0)
