"""Check registered queries against their SQL: ``python tests/check.py sf0.01 [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from pyspark.sql import SparkSession

import __spark_entry__ as entry_points
from compare import difference


def main(scale: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name in [q for q in queries if not names or any(q.startswith(n) for n in names)]:
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, queries[name], oracles[name], f"/root/testdata/{scale}")
            else:
                n = queries[name](spark, f"/root/testdata/{scale}").count()
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
