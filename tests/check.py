"""python tests/check.py [folder] [name-prefix ...]: compare registered queries with their twins."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from granary import catalog
from granary.session import build_session
from tests.compare import difference, open_tables


def main(folder: str, prefixes: list[str]) -> int:
    spark = build_session(
        "granary-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    oracles = catalog.oracles()
    failed = 0
    for name, build in catalog.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                found = difference(df, con, oracles[name])
                kind = "sql"
            else:
                found, kind = (None if df.count() else "empty"), "rows"
        except Exception as e:
            found, kind = f"{type(e).__name__}: {str(e)[:600]}", "error"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
