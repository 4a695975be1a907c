"""Compare all (or the named) registered queries with their SQL: python tests/check_queries.py DIR [name…]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from barline.session import get_session  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = get_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                verdict, timing = oracle.compare(df, con, sqls[name])
            else:
                verdict, timing = "ok", f"rows only {len(df.collect())}"
        except Exception as err:  # report and go on to the next query
            verdict, timing = f"ERROR {type(err).__name__}: {str(err)[:600]}", ""
        if verdict != "ok":
            failed.append(name)
        print(f"{name:32s} {time.time() - t:6.1f}s {timing}  {verdict}", flush=True)
    print("failed:", failed)


main()
