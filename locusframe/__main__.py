"""python -m locusframe QUERY TABLES OUT [FORMAT]: runs a query over a folder of tables and writes its rows; without arguments it lists the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from locusframe.plans.files import QUERIES


def main(args: list[str]) -> int:
    if len(args) not in (3, 4) or args[0] not in QUERIES:
        print(__doc__, *sorted(QUERIES), sep="\n")
        return 0 if not args else 2
    spark = SparkSession.builder.appName(f"locusframe {args[0]}").getOrCreate()
    QUERIES[args[0]](spark, args[1]).write.format(args[3] if len(args) > 3 else "parquet").save(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
