"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). On one machine one is made where none is set; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lineage ends at files every executor sees.

    Shuffle files go when the driver finds their plans to be garbage, so it is asked to look once a table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def recorded(make: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """What make returns, and the tables that materialise() wrote meanwhile."""
    start = len(_written)
    out = make()
    return out, _written[start:]


def final_table(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, a table it materialised last; the tables it wrote before that are deleted."""
    out, written = recorded(make)
    drop_tables(out.sparkSession, written[:-1])
    return out


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables, and empties the list; call it once nothing reads them any more."""
    while paths:
        name = paths.pop()
        if name in _written:
            _written.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
