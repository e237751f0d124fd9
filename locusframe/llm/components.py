"""Connected components of undirected edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import drop_tables, materialise, recorded


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of long ids in, (id, root) out for every id of an edge that isn't the least of its component; root is the least.

    Each round ends at a table in the shared folder. Rounds are logarithmic in the longest path.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, before = None, []
    while True:
        edges, written = recorded(lambda e=edges: materialise(_stars(_stars(e, True), False), "stars"))
        drop_tables(edges.sparkSession, before)
        before = written
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (now.n, now.h):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = (now.n, now.h)
