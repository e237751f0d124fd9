"""Helpers shared by the training-data operators: scratch tables, column guards and row keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.scratch import drop_tables, final_table, materialise, recorded, shared_dir

__all__ = ["ascii_lower", "batch_rows", "drop_tables", "final_table", "materialise", "pieces", "recorded", "row_keys", "shared_dir", "table", "text_or_empty"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run inside, Arrow batches have at most so many rows: a batch of long texts is held by the JVM and by the Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows, so that what is made of a batch at once stays small. In the end the worker gives back what Arrow holds free."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def row_keys(df: DataFrame, id_col: str, text: Column) -> tuple[list[Column], bool]:
    """Columns none, doc and sub that tell texts apart and order them, and whether ids repeat.

    none says that the id is null, which comes last; doc is the id, or a hash of the text without one; sub is a hash of
    the text, 0 where no id of df repeats. So rows are one document only if they share id and text: null ids have 128
    bits of hash, and texts of a repeated id 64.
    """
    i = F.col(id_col).cast("long")
    repeats = not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    sub = F.xxhash64(text) if repeats else F.when(i.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    return [i.isNull().alias("none"), F.coalesce(i, F.xxhash64(F.lit(1), text)).alias("doc"), sub.alias("sub")], repeats
