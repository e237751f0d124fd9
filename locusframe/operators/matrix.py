"""Feature assembly, interactions, standardising and linear scores, each as one projection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.operators.scan import running
from locusframe.scratch import materialise


def assemble(parts: list[DataFrame]) -> DataFrame:
    """Joins feature tables on motif_id."""
    return reduce(lambda a, b: a.join(b, "motif_id"), parts)


def derive(d: DataFrame, near: int = 1000, stats_of: DataFrame | None = None) -> DataFrame:
    """Derived columns of (score, dtss, acces, footprint, cpg_wr4, gc_w4, ...).

    tss is the level number of dtss < near (1 if it is the same everywhere, else 1 or 2), motif_score is (-ln score -
    mean) / mean with the mean over all rows before any is dropped, acces and footprint move up by 1, cpg_island is 2
    where cpg_wr4 > 0.6 and gc_w4 > 0.5. The means and levels come from one aggregate, not from a global window: of
    stats_of if given, a cheaper table with score and dtss of the same sites.
    """
    whole = (d if stats_of is None else stats_of).agg(F.avg(-F.ln("score")).alias("__mean"), F.count_distinct(F.col("dtss") < near).alias("__levels"))
    x = d.crossJoin(F.broadcast(whole))  # one row
    return x.select(
        *[c for c in d.columns if c not in ("score", "acces", "footprint", "cpg_wr4", "gc_w4")],
        ((-F.ln("score") - F.col("__mean")) / F.col("__mean")).alias("motif_score"),
        F.when(F.col("__levels") < 2, 1).otherwise((F.col("dtss") < near).cast("int") + 1).alias("tss"),
        (F.col("acces") + 1).alias("acces"), (F.col("footprint") + 1).alias("footprint"),
        F.when((F.col("cpg_wr4") > 0.6) & (F.col("gc_w4") > 0.5), 2).otherwise(1).alias("cpg_island"),
    )


def finish(d: DataFrame, mappable: DataFrame | None = None, n: int | None = None, seed: int = 1, drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of d that are in mappable (motif_id), if given, and complete; n of them by take_sample(), if given; without the columns in drop, such as coordinates."""
    rows = d if mappable is None else d.join(mappable.select("motif_id"), "motif_id", "left_semi")
    rows = rows.na.drop("any", subset=[c for c in d.columns if c not in drop])
    return (rows if n is None else take_sample(rows, n, seed)).drop(*drop)


def cut_counts(counts: DataFrame, mappable: DataFrame, one_in: float = 1.0, seed: int = 1) -> DataFrame:
    """counts (motif_id, cut_count, ...) at mappable sites, and of them one in so many, rounded, without replacement."""
    kept = counts.join(mappable.select("motif_id"), "motif_id", "left_semi")
    return kept if one_in == 1 else take_share(kept, one_in, seed)


def take_share(d: DataFrame, one_in: float, seed: int = 1, id_col: str = "motif_id") -> DataFrame:
    """take_sample() of one row in so many, rounded."""
    return take_sample(d, lambda rows: int(rows / one_in + 0.5), seed, id_col)


def take_sample(d: DataFrame, n: int | Callable[[int], int], seed: int = 1, id_col: str = "motif_id") -> DataFrame:
    """n rows without replacement (n may depend on how many there are): those of smallest seeded hash, ties by id, the same on any partitioning. Of rows that share an id any are taken first; a null id is an id.

    A histogram of hash prefixes, of 65,536 rows at most, tells which prefix the n-th row has. Rows of smaller ones are taken
    by a filter, and those of that prefix by their ranks, a prefix scan; no task sorts the sample.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    prefix = F.substring("__hash", 1, 4)
    hashed = d.withColumn("__hash", key)
    counts = hashed.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows"))
    line = W.orderBy("prefix")  # 65,536 rows at most
    counts = materialise(counts.select("prefix", F.sum("rows").over(line).alias("upto"), "rows"), "prefixes")
    total = counts.agg(F.max("upto")).first()[0] or 0
    n = n(total) if callable(n) else n
    if n >= total:
        return d
    if n <= 0:
        return d.where(F.lit(False))
    edge = counts.where(F.col("upto") >= n).orderBy("prefix").first()
    ranked = running(hashed.where(prefix == edge.prefix), [], ["__hash", id_col], {"__rank": ("sum", F.lit(1).cast("long"))}, name="edge")
    return hashed.where(prefix < edge.prefix).select(*d.columns).unionAll(ranked.where(F.col("__rank") <= n - (edge.upto - edge.rows)).select(*d.columns))


def interactions(d: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, columns, and the product of each pair of columns i <= j, named 'a x b'."""
    products = [(F.col(a) * F.col(b)).alias(f"{a} x {b}") for i, a in enumerate(columns) for b in columns[i:]]
    return d.select(*keep, *columns, *products)


def standardise(d: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(x - mean) / sample deviation of each column; null where the deviation is 0."""
    whole = d.agg(*[f(F.col(c)).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    x = d.crossJoin(F.broadcast(whole))  # one row
    return x.select(*keep, *[((F.col(c) - F.col(f"__m{i}")) / F.nullif(F.col(f"__s{i}"), F.lit(0.0))).alias(c) for i, c in enumerate(columns)])


def linear_score(d: DataFrame, weights: dict[str, float], intercept: float, keep: list[str]) -> DataFrame:
    """keep and score, the weighted sum of columns."""
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") * F.lit(float(w)) for c, w in weights.items()], F.lit(float(intercept)))
    return d.select(*keep, total.alias("score"))
