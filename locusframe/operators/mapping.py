"""Choosing models for new samples: pair matrices, weights, robust regression on similarities, and the best model of each target."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.kernels.numeric import bisquare_fit, density_mode

#: Metric numbers of the cross, score-only and score-only area metrics; the model name that stands for the score alone.
CROSS, SCORE_ONLY, SCORE_AREA, DEFAULT = 5, 9, 11, "default"
#: Log scores at or below the first become the second, and pairs above the third are fitted.
LOW, LOW_VALUE, FITTED = -2.0, -300.0, -100.0


def sample_pairs(samples: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """(model, target, similarity): all ordered pairs of samples, or those of new targets with samples; similarity where it is computed (model >= target). Sample names are few."""
    a, b = samples.select(F.col("sample").alias("model")), (new or samples).select(F.col("sample").alias("target"))
    return a.crossJoin(F.broadcast(b)).withColumn("similarity", F.col("model") >= F.col("target"))


def log_matrix(y: DataFrame) -> DataFrame:
    """(model, target, value): ln of the cross metric of each pair, and for model 'default' ln of the score-only metric of each target's own row."""
    pairs = y.where(F.col("metric") == CROSS).select("model", "target", F.ln("value").alias("value"))
    own = y.where((F.col("metric") == SCORE_ONLY) & (F.col("model") == F.col("target"))).select(F.lit(DEFAULT).alias("model"), "target", F.ln("value").alias("value"))
    return pairs.unionAll(own)


def row_weights(y: DataFrame, gamma: float) -> DataFrame:
    """(model, weight): gamma where the own score area is below 0.8, else 1 where the own model beats the score by over a tenth, else gamma."""
    own = y.where(F.col("model") == F.col("target")).groupBy("model").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"m{m}") for m in (CROSS, SCORE_ONLY, SCORE_AREA)])
    return own.select("model", F.when(F.col("m11") < 0.8, gamma).when(F.try_divide(F.col("m5"), F.col("m9")) > 1.1, 1.0).otherwise(gamma).alias("weight"))


def weighted(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    return matrix.join(weights, "model", "left").select("model", "target", (F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("value"))


def centred(matrix: DataFrame) -> DataFrame:
    """Values less the mean of their target, the default row among them."""
    return matrix.select("model", "target", (F.col("value") - F.avg("value").over(W.partitionBy("target"))).alias("value"))


def thresholded(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("value", F.when((F.col("model") != DEFAULT) & (F.col("value") <= LOW), LOW_VALUE).otherwise(F.col("value")))


def selected_matrix(y: DataFrame, gamma: float) -> DataFrame:
    """The matrix that models are fitted on: logs, weighted by row, centred, thresholded."""
    return thresholded(centred(weighted(log_matrix(y), row_weights(y, gamma))))


def symmetric(matrix: DataFrame) -> DataFrame:
    """(high, low, value): the mean of both directions of each pair of different samples."""
    return matrix.where((F.col("model") != F.col("target")) & (F.col("model") != DEFAULT)).groupBy(F.greatest("model", "target").alias("high"), F.least("model", "target").alias("low")).agg(F.avg("value").alias("value"))


def binary_similarity(x: DataFrame, width: float = 8.0) -> DataFrame:
    """(model, target, feature, similar) for model > target: 1 where ln p is no lower than the feature's diagonal mean less width deviations."""
    d = x.where(F.col("model") == F.col("target")).groupBy("feature").agg(F.avg(F.ln("pvalue")).alias("m"), F.stddev_samp(F.ln("pvalue")).alias("s"))
    return x.where(F.col("model") > F.col("target")).join(F.broadcast(d), "feature").select("model", "target", "feature", (F.ln("pvalue") >= F.col("m") - width * F.col("s")).cast("int").alias("similar"))


def without_samples(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs neither of whose samples is in held (sample)."""
    return pairs.join(held, F.col("sample") == F.col("model"), "left_anti").join(held, F.col("sample") == F.col("target"), "left_anti")


def assemble(similar: DataFrame, values: DataFrame, features: list[str]) -> DataFrame:
    """(high, low, features ..., y): the binary features of each pair beside its symmetric value."""
    wide = similar.groupBy(F.col("model").alias("high"), F.col("target").alias("low")).pivot("feature", features).agg(F.max("similar"))
    return wide.join(values.withColumnRenamed("value", "y"), ["high", "low"], "left")


def robust_fit(pairs: DataFrame, features: list[str], c: float) -> DataFrame:
    """(term, coefficient) of the bisquare regression of y on the features, over fitted pairs. Pairs of samples are thousands at most (98 samples in the field's use); more than MAX_PAIRS raise."""
    x, y, _ = _collected(pairs, features)
    beta, _ = bisquare_fit(x, y, c)
    return pairs.sparkSession.createDataFrame([(t, float(b)) for t, b in zip(["intercept", *features], beta, strict=True)], "term string, coefficient double")


MAX_PAIRS = 200_000


def _collected(pairs: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    d = pairs.orderBy("high", "low").limit(MAX_PAIRS + 1).toPandas()
    if len(d) > MAX_PAIRS:
        raise ValueError("too many pairs of samples")
    known = d[d["y"].notna() & (d["y"].fillna(FITTED) > FITTED)]
    return known[features].to_numpy(float), known["y"].to_numpy(float), d


def transferred(known: pd.DataFrame, weights: np.ndarray, unknown: pd.DataFrame, features: list[str]) -> np.ndarray:
    """For each unknown pair the density mode of the weights of the known pairs nearest in scaled features."""
    x = known[features].to_numpy(float)
    scale = np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1.0)
    z, u = x / scale, unknown[features].to_numpy(float) / scale
    patterns, code = np.unique(u, axis=0, return_inverse=True)
    modes = []
    for p in patterns:
        d = ((z - p) ** 2).sum(axis=1)
        modes.append(density_mode(weights[d <= d.min() + 1e-12]))
    return np.array(modes)[code.ravel()] if len(u) else np.zeros(0)


def fitted_pairs(d: pd.DataFrame, features: list[str], c: float) -> pd.DataFrame:
    """d with fitted: the intercept plus weight times the regression's other terms; pairs without y borrow a weight."""
    known = d[d["y"].notna() & (d["y"].fillna(FITTED) > FITTED)]
    rest = d.drop(known.index)
    beta, w = bisquare_fit(known[features].to_numpy(float), known["y"].to_numpy(float), c)
    out = d.copy()
    out["weight"] = 0.0
    out.loc[known.index, "weight"] = w
    out.loc[rest.index, "weight"] = transferred(known, w, rest, features)
    out["fitted"] = beta[0] + out["weight"] * (out[features].to_numpy(float) @ beta[1:])
    return out


def best_models(matrix: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(target, model): the model of largest value; of equal ones that with the largest default value of its own, then the larger name. 'default' where the model's own default value is above its value over gamma."""
    base = matrix.where(F.col("model") == DEFAULT).select(F.col("target").alias("d_model"), F.col("value").alias("base"))
    models = matrix.where((F.col("model") != DEFAULT) & (F.col("model") != F.col("target"))).join(base, F.col("model") == F.col("d_model"), "left")
    best = models.groupBy("target").agg(F.max(F.struct("value", "base", "model")).alias("best"))
    return best.select("target", F.when(F.col("best.base") > F.col("best.value") / gamma, DEFAULT).otherwise(F.col("best.model")).alias("model"))


def _training(cells: pd.DataFrame, out: set[str]) -> tuple[dict, dict]:
    """The symmetric value of each pair and the default value of each sample from logs of pairs without the samples in out: centred by target, thresholded."""
    d = cells[~cells["model"].isin(out) & ~cells["target"].isin(out)]
    v = d["value"] - d.groupby("target")["value"].transform("mean")
    model, target = d["model"].to_numpy(object), d["target"].to_numpy(object)
    base = {t: x for m, t, x in zip(model, target, v, strict=True) if m == DEFAULT}
    sums: dict[tuple, list[float]] = {}
    for m, t, x in zip(model, target, v, strict=True):
        if m != DEFAULT and m != t:
            sums.setdefault((max(m, t), min(m, t)), []).append(LOW_VALUE if x <= LOW else x)
    return {k: float(np.mean(x)) for k, x in sums.items()}, base


def _chosen(fitted: pd.DataFrame, targets: list[str], models: set[str], base: dict, gamma: float) -> list[tuple[str, list[str], float]]:
    """(target, models, fitted value): the models of largest fitted value, of several those with the largest default value of their own; 'default' where that is above the fitted value over gamma."""
    out = []
    for t in targets:
        mine = fitted[(fitted["high"] == t) | (fitted["low"] == t)]
        others = np.where(mine["high"] == t, mine["low"], mine["high"])
        found = [(f, m) for f, m in zip(mine["fitted"], others, strict=True) if m in models]
        if not found:
            out.append((t, [], np.nan))
            continue
        top = max(f for f, _ in found)
        best = [m for f, m in found if f == top]
        own = max(base.get(m, -np.inf) for m in best)
        best = sorted(m for m in best if base.get(m, -np.inf) == own)
        out.append((t, [DEFAULT] if own > top / gamma else best, top))
    return out


def cross_validate(pairs: DataFrame, matrix: DataFrame, features: list[str], grid: list[float], folds: int, gamma: float = 1.0, seed: int = 1, logs: DataFrame | None = None, held: list[str] | None = None) -> DataFrame:
    """(c, target, model, fitted, value, base): for each constant and fold, pairs of the fold's samples are fitted without their y, and each of these samples gets a model of the other folds.

    model joins several equally good ones by commas; value is what they reach in the matrix, base what 'default' does.
    With logs (weighted logs of pairs, not centred) a fold's y are made without its samples; else y of pairs and the
    default row of the matrix are taken. held names samples that no fold knows and that get no model here. One task for
    each (c, fold); the pair table, bounded by MAX_PAIRS, and the cells of its pairs go to each.
    """
    shared, samples = _shared(pairs, matrix, features, logs)
    rest = [s for s in samples if s not in set(held or [])]
    order = np.random.default_rng(seed).permutation(len(rest))
    fold_of = {rest[i]: int(k % folds) for k, i in enumerate(order)}
    never = set(held or [])

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        c, fold = key
        mine = sorted(s for s, f in fold_of.items() if f == fold)
        rows = _mapped(shared.value, features, c, gamma, set(mine) | never, mine)
        return pd.DataFrame([(c, *r) for r in rows], columns=["c", "target", "model", "fitted", "value", "base"])

    jobs = pairs.sparkSession.createDataFrame([(float(c), f) for c in grid for f in range(folds)], "c double, fold int")
    return jobs.groupBy("c", "fold").applyInPandas(run, "c double, target string, model string, fitted double, value double, base double")


def _shared(pairs: DataFrame, matrix: DataFrame, features: list[str], logs: DataFrame | None):
    """The broadcast pair table, cells and logs of its samples, and the samples."""
    spark = pairs.sparkSession
    _, _, table = _collected(pairs, features)
    samples = sorted(set(table["high"]) | set(table["low"]))
    wanted = [*zip(table["high"], table["low"], strict=True), *zip(table["low"], table["high"], strict=True), *((DEFAULT, s) for s in samples), *((s, s) for s in samples)]
    wanted = spark.createDataFrame(wanted, "model string, target string")  # of each pair a target can get, so the matrix of other samples stays where it is

    def cells(m: DataFrame) -> pd.DataFrame:
        found = m.join(wanted, ["model", "target"], "left_semi").limit(MAX_PAIRS * 4 + 1).toPandas()
        if len(found) > MAX_PAIRS * 4:
            raise ValueError("too many cells of pairs of samples")
        return found.sort_values(["model", "target"])

    found = cells(matrix)
    value = {(m, t): v for m, t, v in zip(found["model"], found["target"], found["value"], strict=True)}
    return spark.sparkContext.broadcast((table, value, None if logs is None else cells(logs))), samples


def _mapped(shared: tuple, features: list[str], c: float, gamma: float, out: set[str], targets: list[str]) -> list[tuple]:
    """(target, model, fitted, value, base) of targets, from a fit without the samples in out, whose models aren't chosen."""
    table, values, logs = shared
    d = table.copy()
    if logs is None:
        d.loc[d["high"].isin(out) | d["low"].isin(out), "y"] = np.nan
        base = {t: v for (m, t), v in values.items() if m == DEFAULT and t not in out}
    else:
        y, base = _training(logs, out)
        d["y"] = [y.get(k, np.nan) for k in zip(d["high"], d["low"], strict=True)]
    fitted = fitted_pairs(d, features, c)
    models = (set(d["high"]) | set(d["low"])) - out
    rows = []
    for t, best, top in _chosen(fitted, targets, models, base, gamma):
        got = [values[m, t] for m in best if (m, t) in values]
        rows.append((t, ",".join(best) or None, None if np.isnan(top) else float(top), float(np.mean(got)) if got else None, values.get((DEFAULT, t))))
    return rows


def grid(high: float = 15.0, low: float = 2.0, step: float = 0.2) -> list[float]:
    return [round(high - step * i, 10) for i in range(int(round((high - low) / step)) + 1)]


def best_constant(validated: DataFrame) -> float:
    """The constant with the largest gain over 'default'; of equal ones the largest, which is tried first."""
    return float(validated.groupBy("c").agg(F.sum(F.col("value") - F.col("base")).alias("gain")).orderBy(F.desc_nulls_last("gain"), F.desc("c")).first()["c"])


def map_samples(pairs: DataFrame, matrix: DataFrame, features: list[str], constants: list[float] | None = None, folds: int | None = 8, gamma: float = 1.0, logs: DataFrame | None = None, held: list[str] | None = None, seed: int = 1) -> tuple[float, DataFrame]:
    """The constant that gains most over 'default' in cross-validation without the held samples, and each sample's row: target, held_out, model, fitted, value, own, base, random and best.

    The final fit knows all samples but the held ones, and only their models are chosen. value, own, base, random and
    best are the matrix's values of the chosen model, the sample's own, 'default', one model by a seeded hash, and the
    best model or 'default'; null where the matrix has none, as for samples that are new. folds None leaves one sample
    out at a time.
    """
    constants, held = constants or grid(), sorted(set(held or []))
    if folds is None:
        folds = pairs.select("high").union(pairs.select("low")).distinct().count() - len(held)
    c = best_constant(cross_validate(pairs, matrix, features, constants, folds, gamma, seed, logs, held))
    shared, samples = _shared(pairs, matrix, features, logs)

    def run(batches):
        for _ in batches:
            yield pd.DataFrame(_mapped(shared.value, features, c, gamma, set(held), samples), columns=["target", "model", "fitted", "value", "base"])

    chosen = pairs.sparkSession.range(0, 1, 1, 1).mapInPandas(run, "target string, model string, fitted double, value double, base double")
    known = matrix.where(~F.col("model").isin(held)) if held else matrix
    others = known.where(F.col("model") != F.col("target")).groupBy("target").agg(
        F.min_by(F.when(F.col("model") != DEFAULT, F.col("value")), F.when(F.col("model") != DEFAULT, F.struct(F.xxhash64(F.lit(seed), "model", "target"), "model"))).alias("random"), F.max("value").alias("best")
    )
    own = matrix.where(F.col("model") == F.col("target")).select("target", F.col("value").alias("own"))
    rows = chosen.join(own, "target", "left").join(others, "target", "left")
    return c, rows.select("target", F.col("target").isin(held).alias("held_out") if held else F.lit(False).alias("held_out"), "model", "fitted", "value", "own", "base", "random", "best")


def gamma_runs(run: Callable[[float], DataFrame], gammas: list[float]) -> DataFrame:
    """The results of run for each gamma, with the gamma."""
    out = None
    for g in gammas:
        part = run(g).withColumn("gamma", F.lit(float(g)))
        out = part if out is None else out.unionByName(part)
    return out
