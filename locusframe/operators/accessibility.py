"""Accessibility calls: score grids, mixture fits on count histograms, bootstraps and simulated counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.kernels import mixture
from locusframe.kernels.mixture import Mixture
from locusframe.scratch import materialise

#: Distinct counts that a histogram may have for a fit; far beyond what windows of some hundred bases hold.
MAX_COUNTS = 5_000_000


def histogram(counts: DataFrame, count: str = "count") -> DataFrame:
    """(count, n): how many rows have each rounded count."""
    return counts.groupBy(F.rint(count).cast("long").alias("count")).agg(F.count("*").alias("n"))


def _steps(mu: float, theta: float) -> Column:
    k = F.col("count").cast("double")
    return F.when(F.col("count") == 0, F.lit(theta * math.log(theta / (theta + mu)))).otherwise(F.ln((k - 1 + theta) / F.when(k > 0, k).otherwise(1.0)) + math.log(mu / (mu + theta)))


def score_grid(top: DataFrame, m: Mixture, column: str = "top", block: int = 1 << 16) -> DataFrame:
    """(count, l1, l2, score) for counts from 0 to the one value in top: log densities as running sums, and the log-likelihood ratio.

    Sums run in blocks of counts, with those of the blocks before added, so the largest count sizes no row and no task.
    """
    first = F.col("block") * block
    blocks = top.select(F.col(column).cast("long").alias("top")).where("top >= 0").select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / block))).alias("block"))
    steps = blocks.select("block", F.explode(F.sequence(first, F.least(first + block - 1, F.col("top")))).alias("count")).select("block", "count", _steps(m.mu1, m.theta1).alias("s1"), _steps(m.mu2, m.theta2).alias("s2"))
    before = steps.groupBy("block").agg(F.sum("s1").alias("b1"), F.sum("s2").alias("b2"))
    line = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    before = before.select("block", *[F.coalesce(F.sum(b).over(line), F.lit(0.0)).alias(b) for b in ("b1", "b2")])
    upto = W.partitionBy("block").orderBy("count").rowsBetween(W.unboundedPreceding, W.currentRow)
    grid = steps.select("block", "count", F.sum("s1").over(upto).alias("s1"), F.sum("s2").over(upto).alias("s2")).join(F.broadcast(before), "block")
    grid = grid.select("count", (F.col("s1") + F.col("b1")).alias("l1"), (F.col("s2") + F.col("b2")).alias("l2"))
    return grid.withColumn("score", F.col("l2") - F.col("l1") + F.lit(math.log((1 - m.prob1) / m.prob1)))


def cutoff(grid: DataFrame) -> DataFrame:
    """(cutoff): the least count of 1 or more with a score above ln 2 and above the score before it; null if there is none."""
    before = grid.select((F.col("count") + 1).alias("count"), F.col("score").alias("before"))
    return grid.join(before, "count").where((F.col("count") >= 1) & (F.col("score") > math.log(2)) & (F.col("score") > F.col("before"))).agg(F.min("count").alias("cutoff"))


def repaired(grid: DataFrame, m: Mixture) -> DataFrame:
    """The grid with scores that go on falling at small counts if zeros are modelled: below the least score's count, least - its count + count."""
    if m.prob0 <= 1e-3:
        return grid
    low = grid.agg(F.min_by(F.struct("score", "count"), F.struct("score", "count")).alias("low"))
    return grid.crossJoin(F.broadcast(low)).withColumn("score", F.when(F.col("count") < F.col("low.count"), F.col("low.score") - F.col("low.count") + F.col("count")).otherwise(F.col("score"))).drop("low")


def call_sites(counts: DataFrame, m: Mixture, legacy: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """counts (motif_id, cut_count, and what keep names) with score and accessible (count >= cutoff; null without a cutoff).

    Counts are written once, as their largest and the calls both read them, and scored a row a different count.
    """
    counts = materialise(counts.select("motif_id", "cut_count", *keep, F.rint("cut_count").cast("long").alias("count")), "counts")
    grid = materialise(score_grid(counts.agg(F.max("count").alias("top")), m), "grid")
    used = repaired(grid, m) if legacy else grid
    rows = counts.join(used.select("count", "score"), "count").crossJoin(F.broadcast(cutoff(grid)))  # one row
    return rows.select("motif_id", "cut_count", *keep, "score", (F.col("count") >= F.col("cutoff")).cast("int").alias("accessible"))


def posterior_sums(hist: DataFrame, m: Mixture) -> DataFrame:
    """(zero, one, two): expected numbers of rows of each component."""
    grid = score_grid(hist.agg(F.max("count").alias("top")), m)
    zero = F.when(F.col("count") == 0, F.lit(m.prob0)).otherwise(0.0)
    one, two = F.exp("l1") * ((1 - m.prob0) * m.prob1), F.exp("l2") * ((1 - m.prob0) * (1 - m.prob1))
    rows = hist.join(grid, "count").select("n", zero.alias("a"), one.alias("b"), two.alias("c")).withColumn("s", F.col("a") + F.col("b") + F.col("c"))
    return rows.agg(*[F.sum(F.col("n") * F.try_divide(F.col(x), F.col("s"))).alias(k) for x, k in (("a", "zero"), ("b", "one"), ("c", "two"))])


def guess(count: np.ndarray, n: np.ndarray) -> Mixture:
    """Starting values from the histogram: means of the lower nine tenths and the upper tenth."""
    order = np.argsort(count)
    c, w = np.asarray(count, float)[order], np.asarray(n, float)[order]
    low = np.cumsum(w) <= 0.9 * w.sum()
    low[0] = True
    mean = lambda keep: float((c[keep] * w[keep]).sum() / max(1.0, w[keep].sum()))
    return Mixture(max(mean(low), 0.1), 1.0, max(mean(~low), mean(low) + 1, 1.0), 2.0, float(w[c == 0].sum() / w.sum() * 0.5 + 1e-3), 0.9)


_PARAMS = "boot int, mu1 double, theta1 double, mu2 double, theta2 double, prob0 double, prob1 double"


def fit_bootstraps(hist: DataFrame, boots: int, size: int | None = None, start: Mixture | None = None, seed: int = 1, tolerance: float = 1e-8) -> DataFrame:
    """One row of parameters for each resample of the histogram, drawn by a seed for each; boots = 0 fits the histogram itself as boot 0.

    The likelihood sees the data by its histogram only: one row for each distinct count (MAX_COUNTS at most) reaches each fit.
    """
    spark = hist.sparkSession
    rows = hist.orderBy("count").limit(MAX_COUNTS + 1).collect()
    if len(rows) > MAX_COUNTS:
        raise ValueError("too many distinct counts")
    count, n = np.array([r["count"] for r in rows], float), np.array([r["n"] for r in rows], float)
    shared = spark.sparkContext.broadcast((count, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, k = shared.value
        for b in batches:
            out = []
            for boot in b["id"]:
                draw = k
                if boots:
                    total = int(size or k.sum())
                    draw = np.random.default_rng([seed, int(boot)]).multinomial(total, k / k.sum()).astype(float)
                keep = draw > 0
                m, _ = mixture.fit(c[keep], draw[keep], start or guess(c[keep], draw[keep]), tolerance)
                out.append((int(boot), m.mu1, m.theta1, m.mu2, m.theta2, m.prob0, m.prob1))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PARAMS.split(", ")])

    return spark.range(0, max(1, boots), 1, max(1, boots)).mapInPandas(run, _PARAMS)


def mean_parameters(fits: DataFrame) -> DataFrame:
    return fits.agg(*[F.avg(c).alias(c) for c in fits.columns if c != "boot"])


def simulate_counts(spark: SparkSession, num: int, m: Mixture, seed: int = 1, chunk: int = 100_000) -> DataFrame:
    """(id, count): num * prob0 zeros, then counts of the two components, with fixed group sizes, seeded by row chunk."""
    zeros = round(num * m.prob0)
    first = round(num * (1 - m.prob0) * m.prob1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                ids = np.arange(part * chunk, min(num, (part + 1) * chunk))
                r = np.random.default_rng([seed, int(part)])
                one = r.negative_binomial(m.theta1, m.theta1 / (m.theta1 + m.mu1), len(ids))
                two = r.negative_binomial(m.theta2, m.theta2 / (m.theta2 + m.mu2), len(ids))
                yield pd.DataFrame({"id": ids, "count": np.where(ids < zeros, 0, np.where(ids < zeros + first, one, two))})

    return spark.range(0, -(-num // chunk)).mapInPandas(run, "id long, count long")


def q_values(values: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in [0, 1] of a column, in order, and the q-value of each by the tail-area rule. More than MAX_COUNTS distinct values raise."""
    from locusframe.kernels.numeric import tail_q_values

    rows = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n")).limit(MAX_COUNTS + 1).toArrow()
    if rows.num_rows > MAX_COUNTS:
        raise ValueError("too many distinct values")
    v, n = rows.column("value").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(v)
    return v[order], tail_q_values(v[order], n[order]) if len(v) else np.zeros(0)


def mappable(d: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows of d whose q-value of the column is above the threshold. q-values never fall as values grow, so these are the rows from some value on."""
    values, q = q_values(d, column)
    kept = values[q > threshold]
    return d.where(F.col(column).cast("double") >= F.lit(float(kept[0])) if len(kept) else F.lit(False))
