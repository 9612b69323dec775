"""Run queries against their SQL twins: python -m tests.check_oracles [folder] [key ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from tallyframe.session import build_session
from tests.oracle import connect, difference


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(folder), []
    oracles = contract.oracle_sql()
    for key, run in contract.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            if key in oracles:
                problem = difference(run(spark, folder), connection, oracles[key])
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if problem is None else 'BAD'} {key:26} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            bad.append(key)
    print(len(bad), "bad:", *bad)


if __name__ == "__main__":
    main()
