"""Similarity of samples' features: two-sample statistics, and seeded permutation p-values of all pairs."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.kernels.numeric import chi_square_ps, kolmogorov_p
from locusframe.operators.curves import range_cuts
from locusframe.scratch import final_table, materialise

#: Features with at most so many distinct values over both samples are categorical.
CATEGORIES = 6
#: Pairs of samples at most; distinct values of a bucket, about; draws in a block of permutations; draws looked up in one group, about; permutations of a block of chi-square tests.
MAX_PAIRS, BUCKET_VALUES, BLOCK_DRAWS, GROUP_DRAWS, LEVEL_BLOCK = 200_000, 200_000, 1_000_000, 1_000_000, 500


def ks(values: DataFrame) -> DataFrame:
    """(ks) of (value, side), side 0 or 1: the largest distance of the two distribution functions, over counts of distinct values."""
    steps = values.where("value is not null").groupBy("value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    cuts = range_cuts(steps, "value", 256)  # running counts in a value range, plus those of the ranges below
    buckets = steps.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")  # one row
    inside = W.partitionBy("bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = buckets.groupBy("bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    below = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    sums = sums.select(F.col("bucket").alias("k"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("sa", "sb")], *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("sa", "sb")])
    rows = buckets.select("bucket", F.sum("a").over(inside).alias("ca"), F.sum("b").over(inside).alias("cb")).join(sums, F.col("bucket") == F.col("k"))
    gap = F.abs(F.try_divide(F.col("ca") + F.col("sa_below"), F.col("sa_all")) - F.try_divide(F.col("cb") + F.col("sb_below"), F.col("sb_all")))
    return rows.agg(F.max(gap).alias("ks"))


def chi2(values: DataFrame) -> DataFrame:
    """(chi2, df) of (value, side): the table's statistic with levels aligned over both sides."""
    cells = values.where("value is not null").groupBy("value", "side").agg(F.count("*").alias("n"))
    rows, sides = cells.groupBy("value").agg(F.sum("n").alias("row_n")), cells.groupBy("side").agg(F.sum("n").alias("side_n"))
    total = sides.agg(F.sum("side_n").alias("all_n"))
    grid = rows.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(total)).join(cells, ["value", "side"], "left")  # two sides, one total
    expected = F.col("row_n") * F.col("side_n") / F.col("all_n")
    gap = F.coalesce("n", F.lit(0)) - expected
    return grid.agg(F.sum(gap * gap / expected).alias("chi2"), ((F.count_distinct("value") - 1) * (F.count_distinct("side") - 1)).alias("df"))


def _draw_levels(rng: np.random.Generator, counts: np.ndarray, k: int) -> np.ndarray:
    """How many of k rows drawn without replacement have each level."""
    if counts.sum() < 10**9:  # numpy's limit
        return rng.multivariate_hypergeometric(counts, k, method="marginals")
    rows = rng.choice(int(counts.sum()), k, replace=False, shuffle=False)
    return np.bincount(np.searchsorted(np.cumsum(counts), rows, side="right"), minlength=len(counts))


def _key(*names: object) -> list[int]:
    """Numbers that seed a generator for these names."""
    return np.frombuffer(hashlib.sha256("\0".join(map(str, names)).encode()).digest()[:16], np.uint32).tolist()


@lru_cache(maxsize=64)
def _ks_p(k: int) -> np.ndarray:
    """p-values of two samples of k rows whose distribution functions differ by 0, 1, ... k rows."""
    return np.array([kolmogorov_p(i / k, k, k) for i in range(k + 1)])


def _ks_ps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-value of each row of a against the same row of b; both have k columns."""
    k = a.shape[1]
    x = np.concatenate([a, b], axis=1)
    order = np.argsort(x, axis=1, kind="stable")
    x = np.take_along_axis(x, order, axis=1)
    ahead = np.abs(np.cumsum(np.where(order < k, 1, -1), axis=1))
    tied = (x[:, 1:] == x[:, :-1]) | (np.isnan(x[:, 1:]) & np.isnan(x[:, :-1]))  # counts are whole after the last of equal values
    ahead[:, :-1][tied] = 0
    return _ks_p(k)[ahead.max(axis=1)]


def _look_up(drawn: pa.Table, held: pa.Table) -> pa.Table:
    """Values of the rows drawn from a bucket: held has its values and how many rows have each. Arrow, as the draws would be Python objects on their way from pandas."""
    value, n = held["value"].to_numpy(), held["n"].to_numpy()
    order = np.argsort(value)
    rows = pa.concat_arrays(drawn["row"].chunks) if drawn.num_rows else pa.array([], drawn.schema.field("row").type)
    found = value[order][np.searchsorted(np.cumsum(n[order]), rows.flatten().to_numpy(), side="right")]
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return drawn.select(["feature", "block", "sample", "side", "at"]).append_column("value", pa.ListArray.from_arrays(offsets, found))


def pair_tests(data: DataFrame, pairs: DataFrame, columns: list[str], size: int = 500, permutations: int = 10_000, seed: int = 1, category_size: int = 10_000) -> DataFrame:
    """(model, target, feature, kind, n, pvalue) for each pair of samples and each column that one of them has values of: how rarely two sub-samples of their pooled values differ as much as sub-samples of the two do.

    data has (sample, columns), pairs (model, target), at most MAX_PAIRS different ones; null samples, samples that no
    pair names and pairs that repeat are left out. Columns of few distinct values over both samples are compared by
    chi-square tests on counts by level of sub-samples of category_size rows, the others by Kolmogorov-Smirnov tests of
    size rows. n is the rows of a sub-sample, fewer than asked if a sample has fewer; without values on one side n is 0
    and pvalue null.

    Values are counted once a sample, and drawn once a sample and side of a pair, not once a pair: a permutation has for
    each sample a sequence of size rows to be compared, and one of 2 * size rows from which pooled sub-samples take as
    many as fall to that sample. Each is a draw without replacement in random order, so its beginning is one too. Every
    row can be drawn: a draw is a number among a sample's rows, which lie in buckets by a hash of their value and in
    order of value in these, and each bucket looks up the numbers that fall into it. Then the sequences of all samples
    meet by block of permutations, and all pairs are tested there. Seeds are permutation, feature and sample, so a pair's
    pvalue depends neither on the other pairs nor on the partitioning.
    """
    return final_table(lambda: _pair_tests(data, pairs, columns, size, permutations, seed, category_size))


def _pair_tests(data: DataFrame, pairs: DataFrame, columns: list[str], size: int, permutations: int, seed: int, category_size: int) -> DataFrame:
    spark = data.sparkSession
    asked = [tuple(r) for r in pairs.where("model is not null and target is not null").select(F.col("model").cast("string"), F.col("target").cast("string")).distinct().limit(MAX_PAIRS + 1).collect()]
    if len(asked) > MAX_PAIRS:
        raise ValueError("too many pairs of samples")
    named = spark.createDataFrame([(s,) for s in sorted({s for p in asked for s in p})], "named string")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]).cast("array<struct<feature:string,value:double>>"))
    long = data.select(F.col("sample").cast("string").alias("sample"), values.alias("x")).where("x.value is not null").join(named, F.col("sample") == F.col("named"), "left_semi")
    counted = materialise(long.groupBy("x.feature", "sample", "x.value").agg(F.count("*").alias("n")), "values")

    # A row a feature and sample, and counts by level of those that may be categorical.
    whole = {(r["feature"], r["sample"]): (r["levels"], r["n"]) for r in counted.groupBy("feature", "sample").agg(F.count("*").alias("levels"), F.sum("n").alias("n")).collect()}
    levels: dict[tuple, dict[float, int]] = {k: {} for k, (n, _) in whole.items() if n <= CATEGORIES}
    few = counted.groupBy("feature", "sample").agg(F.count("*").alias("levels")).where(F.col("levels") <= CATEGORIES).drop("levels")
    for r in counted.join(few, ["feature", "sample"]).collect():
        levels[r["feature"], r["sample"]][r["value"]] = r["n"]

    tests, by_level, by_rank = [], [], defaultdict(list)
    for c in sorted({c for c, _ in whole}):
        for a, b in asked:
            sides = [(c, a), (c, b)]
            if not any(s in whole for s in sides):
                continue
            small = all(s in levels or s not in whole for s in sides) and len(set().union(*(levels.get(s, ()) for s in sides))) <= CATEGORIES
            n = int(min(category_size if small else size, *(whole[s][1] if s in whole else 0 for s in sides)))
            tests.append((a, b, c, "chi2" if small else "ks", n))
            if n and small:
                by_level.append((c, a, b, n))
            elif n:
                by_rank[c].append((a, b, n))
    tables = {k: levels[k] for c, a, b, _ in by_level for k in ((c, a), (c, b))}
    drawn = sorted({(c, s, side) for c, found in by_rank.items() for p in found for side, s in enumerate(p[:2])})
    buckets = {(c, s): -(-whole[c, s][0] // BUCKET_VALUES) for c, s, _ in drawn}
    per_block = max(1, BLOCK_DRAWS // (3 * size * max(1, len({(s, side) for _, s, side in drawn}))))
    #: A bucket's values go to so many groups, each with a share of the blocks.
    parts = {k: max(1, -(-3 * size * permutations // (n * GROUP_DRAWS))) for k, n in buckets.items()}

    dealt = spark.createDataFrame([(*k, n, parts[k]) for k, n in buckets.items()], "k_feature string, k_sample string, buckets int, parts int")
    held = counted.join(dealt, (F.col("feature") == F.col("k_feature")) & (F.col("sample") == F.col("k_sample")))
    held = held.withColumn("bucket", F.pmod(F.xxhash64("value"), F.col("buckets")).cast("int")).select("feature", "sample", "bucket", "parts", "value", "n")
    ends = {k: np.zeros(n, np.int64) for k, n in buckets.items()}  # rows up to the end of each bucket
    for r in held.groupBy("feature", "sample", "bucket").agg(F.sum("n").alias("n")).collect() if buckets else []:
        ends[r["feature"], r["sample"]][r["bucket"]] = r["n"]
    ends = {k: np.cumsum(n) for k, n in ends.items()}
    shared = spark.sparkContext.broadcast((tables, ends, parts, dict(by_rank), {k: n for k, (_, n) in whole.items()}))

    def jobs(cells: list[tuple], schema: str, each: int) -> DataFrame:
        blocks = -(-permutations // each)
        out = spark.createDataFrame(cells, schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return out.repartition(max(1, min(len(cells) * blocks, 4 * spark.sparkContext.defaultParallelism)))

    def test_levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for c, a, b, k, block in d.itertuples(index=False):
                sides = [shared.value[0][c, s] for s in (a, b)]
                at = sorted(set().union(*sides))
                counts = [np.array([x.get(v, 0) for v in at], np.int64) for x in sides]
                pooled, rng, seen, null = counts[0] + counts[1], np.random.default_rng([seed, block, *_key(c, a, b)]), [], []
                for _ in range(min(LEVEL_BLOCK, permutations - block * LEVEL_BLOCK)):
                    seen.append([_draw_levels(rng, x, k) for x in counts])
                    first = _draw_levels(rng, pooled, k)
                    null.append([first, _draw_levels(rng, pooled - first, k)])
                p = [chi_square_ps(x[:, 0], x[:, 1]) for x in (np.array(seen), np.array(null))]
                yield pd.DataFrame({"feature": [c], "model": [a], "target": [b], "seen": [p[0]], "null": [p[1]]})

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for c, s, side, block in d.itertuples(index=False):
                upto, key = shared.value[1][c, s], _key(c, s, side)
                rows, at = [], []
                for i in range(min(per_block, permutations - block * per_block)):
                    rng = np.random.default_rng([seed, block * per_block + i, *key])
                    for first, k in ((0, size), (size, 2 * size)):
                        rows.append(rng.choice(int(upto[-1]), int(min(k, upto[-1])), replace=False))
                        at.append(np.arange(len(rows[-1]), dtype=np.int32) + 3 * size * i + first)
                row, at = np.concatenate(rows), np.concatenate(at)
                bucket = np.searchsorted(upto, row, side="right")
                row = row - np.where(bucket > 0, upto[bucket - 1], 0)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                yield pd.DataFrame([(c, s, int(bucket[x[0]]), block % shared.value[2][c, s], side, block, at[x], row[x]) for x in np.split(order, cuts)], columns=["feature", "sample", "bucket", "part", "side", "block", "at", "row"])

    def test_ranks(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        c, block = key[0], int(key[1])
        n = min(per_block, permutations - block * per_block)
        drawn = defaultdict(lambda: np.zeros(n * 3 * size))
        for s, side, at, value in d[["sample", "side", "at", "value"]].itertuples(index=False):
            drawn[s, int(side)][np.asarray(at)] = value
        out = []
        for a, b, k in shared.value[3][c]:
            x, y = (drawn[s, side].reshape(n, 3 * size) for side, s in enumerate((a, b)))
            rows = [shared.value[4][c, s] for s in (a, b)]
            pooled = np.empty((n, 2 * k))
            for i in range(n):  # which of the pooled rows drawn are the one sample's
                ours = np.random.default_rng([seed, block * per_block + i, *_key(c, a, b)]).choice(sum(rows), 2 * k, replace=False) < rows[0]
                pooled[i, ours], pooled[i, ~ours] = x[i, size : size + ours.sum()], y[i, size : size + 2 * k - ours.sum()]
            out.append((c, a, b, _ks_ps(x[:, :k], y[:, :k]), _ks_ps(pooled[:, :k], pooled[:, k:])))
        return pd.DataFrame(out, columns=["feature", "model", "target", "seen", "null"])

    def p_value(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        seen, null = (np.sort(np.concatenate(d[c].tolist())) for c in ("seen", "null"))  # in one order, so that the mean is one
        return pd.DataFrame([(*key, (np.sum(null <= np.mean(seen)) + 1) / (len(null) + 1))], columns=["f", "m", "t", "pvalue"])

    fields = "feature string, model string, target string, seen array<double>, null array<double>"
    found = jobs(by_level, "feature string, model string, target string, n int", LEVEL_BLOCK).mapInPandas(test_levels, fields)
    if drawn:
        numbers = jobs(drawn, "feature string, sample string, side int", per_block).mapInPandas(draw, "feature string, sample string, bucket int, part int, side int, block int, at array<int>, row array<long>")
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        on = ["feature", "sample", "bucket", "part"]
        looked = numbers.groupBy(on).cogroup(held.groupBy(on)).applyInArrow(_look_up, "feature string, block int, sample string, side int, at array<int>, value array<double>")
        found = found.unionAll(looked.groupBy("feature", "block").applyInPandas(test_ranks, fields))
    p = found.groupBy("feature", "model", "target").applyInPandas(p_value, "f string, m string, t string, pvalue double")
    all_tests = spark.createDataFrame(tests, "model string, target string, feature string, kind string, n int")
    same = (F.col("feature") == F.col("f")) & (F.col("model") == F.col("m")) & (F.col("target") == F.col("t"))
    return materialise(all_tests.join(p, same, "left").select("model", "target", "feature", "kind", "n", "pvalue"), "tests")


def permutation_p(one: DataFrame, two: DataFrame, columns: list[str], size: int = 500, permutations: int = 10_000, seed: int = 1, category_size: int = 10_000, names: tuple[str, str] = ("one", "two")) -> DataFrame:
    """(feature, kind, pvalue): pair_tests() of two tables, for the columns that both have. names are the samples' names, which seed the draws; they differ."""
    cols = [c for c in columns if c in one.columns and c in two.columns]
    data = [d.select(F.lit(s).alias("sample"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) for s, d in zip(names, (one, two), strict=True)]
    pair = one.sparkSession.createDataFrame([names], "model string, target string")
    return pair_tests(data[0].unionAll(data[1]), pair, cols, size, permutations, seed, category_size).select("feature", "kind", "pvalue")
