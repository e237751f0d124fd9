"""Segmented prefix scans: running values over the rows of each key, in order, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.scratch import materialise

#: How values of one key are put together: as an aggregate, and of two values.
COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def in_ranges(df: DataFrame, order: list[str | Column], keep: list[str] | None = None, name: str = "ranges", ranges: list[str | Column] | None = None, parts: int | None = None) -> DataFrame:
    """The columns in keep (default: all of df) as a table in the shared folder, dealt to ranges of the order; __at grows along the order, and __part numbers the ranges.

    ranges has what rows are dealt by, if the order is too long for that, as the driver sees a sample of it: the same
    order but for rows that it leaves equal. parts is how many ranges there are, by default as many as shuffles have.
    """
    rows = df.repartitionByRange(*([parts] if parts else []), *(ranges or order)).sortWithinPartitions(*order).select(*(keep or df.columns), F.monotonically_increasing_id().alias("__at"))
    return materialise(rows, name).withColumn("__part", F.shiftright("__at", 33))


def along(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], keep: list[str]) -> DataFrame:
    """The columns in keep, and a running value a row for each of `values`: name -> (one of COMBINE, a column), over the rows of its key up to and with it, for in_ranges() rows by keys and an order.

    Null is a key. Nulls among the values are passed over. A range shares at most its first key with the ranges before
    it: what is carried into ranges has a row a range at most, and is broadcast. One shuffle.
    """
    inside = W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    same_key = W.partitionBy(*keys).orderBy("__part")
    totals = rows.groupBy("__part", *keys).agg(*[COMBINE[how][0](c).alias(n) for n, (how, c) in values.items()])
    carried = totals.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.row_number().over(same_key).alias("__nth"),
        *[COMBINE[how][0](n).over(same_key.rowsBetween(W.unboundedPreceding, -1)).alias(f"__c{i}") for i, (n, (how, _)) in enumerate(values.items())],
    ).where("__nth > 1")
    rows = rows.select(*keep, "__part", *[COMBINE[how][0](c).over(inside).alias(n) for n, (how, c) in values.items()])
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(F.broadcast(carried), same, "left")
    return rows.select(*keep, *[F.coalesce(COMBINE[how][1](F.col(n), F.col(f"__c{i}")), n, f"__c{i}").alias(n) for i, (n, (how, _)) in enumerate(values.items())])


def running(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]], keep: list[str] | None = None, name: str = "scan", ranges: list[str | Column] | None = None) -> DataFrame:
    """along() for the rows of df in ranges of (keys, order), so a key may fill many. Rows of equal order come in any one order, the same for all values. keep has to name the keys and what the values are made of; it is all of df by default."""
    keep = keep or df.columns
    return along(in_ranges(df, [*keys, *order], keep, name, [*keys, *ranges] if ranges else None), keys, values, keep)
