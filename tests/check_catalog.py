"""Compare registered queries with DuckDB: ``python tests/check_catalog.py [sf_dir] [name...]``."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from corpusloom.plans import catalog
from corpusloom.session import get_spark
from tests import oracle


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                         "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    bad = []
    for name, q in catalog.QUERIES.items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            cols, got = oracle.spark_rows(q.run(spark, sf))
        except Exception as e:
            print(f"{name:28s} SPARK ERROR {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - t
        if q.sql is None:
            print(f"{name:28s} rows={len(got):6d} {took:6.2f}s (no SQL)", flush=True)
            continue
        t = time.time()
        try:
            wcols, want = oracle.sql_rows(con, q.sql)
        except Exception as e:
            print(f"{name:28s} SQL ERROR {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        ok = cols == wcols and got == want
        print(f"{name:28s} rows={len(got):6d} {took:6.2f}s sql {time.time() - t:5.2f}s {'ok' if ok else 'MISMATCH'}", flush=True)
        if not ok:
            bad.append(name)
            print("   columns", cols, wcols, "rows", len(got), len(want))
            diff = [(g, w) for g, w in zip(got, want) if g != w]
            for g, w in diff[:2]:
                print("   spark", str(g)[:300], "\n   sql  ", str(w)[:300])
    print("bad:", bad)


if __name__ == "__main__":
    main()
