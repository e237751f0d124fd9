"""What a pair of samples gives to the mapping of models: similarity of features, and performance of models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.curves import NUMBERS, evaluate, metrics
from locusframe.operators.scan import running
from locusframe.operators.similarity import CATEGORIES, pair_tests, permutation_p
from locusframe.scratch import materialise

#: Rows of model or moment tables that are broadcast; the term of a model's constant.
BROADCAST, INTERCEPT = 500_000, "intercept"

# Metrics 1 to 4, 5 to 8 and 9 to 12 are the four NUMBERS of the own model, the other sample's and the score alone.


@dataclass(frozen=True)
class LinearModel:
    """Weights of standardised columns, or with products of their pairwise products ('a x b') too."""

    weights: dict[str, float]
    intercept: float = 0.0
    products: bool = False


def similarity_rows(model: str, target: str, a: DataFrame, b: DataFrame, features: list[str], size: int = 500, permutations: int = 10_000, category_size: int = 10_000) -> DataFrame | None:
    """(model, target, feature, pvalue) of the permutation tests between two samples' tables; None where target precedes model, as each pair is tested once."""
    if model < target:
        return None
    p = permutation_p(a, b, features, size, permutations, category_size=category_size, names=(model, target)) if model != target else permutation_p(a, b, features, size, permutations, category_size=category_size)
    return p.select(F.lit(model).alias("model"), F.lit(target).alias("target"), "feature", "pvalue")


def similarity(data: DataFrame, pairs: DataFrame, features: list[str], size: int = 500, permutations: int = 10_000, category_size: int = 10_000) -> DataFrame:
    """(model, target, feature, kind, n, pvalue): similarity_rows() of all pairs (model, target) of data's samples in one job; pairs whose target precedes the model are left out, as each is tested once."""
    return pair_tests(data, pairs.where("model >= target"), features, size, permutations, category_size=category_size)


def statistics(data: DataFrame, pairs: DataFrame, features: list[str]) -> DataFrame:
    """(model, target, feature, kind, statistic, df) of each pair of data's samples (sample, features ...) and each feature that one of them has values of, over all their rows.

    kind is chi2 for features of at most CATEGORIES distinct values over both samples: the statistic of the table of
    values and samples, and its degrees of freedom; else it is ks: the largest distance of the two distribution
    functions, without df. Without values on one side the statistic is null. Null samples and repeated pairs are left
    out. Values are counted once a sample, and the counts of a pair's samples by value are one key of a prefix scan, so
    neither a pair nor a value is one task's work.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features]))
    counted = materialise(data.select("sample", values.alias("x")).where("x.value is not null").groupBy("sample", "x.feature", "x.value").agg(F.count("*").alias("n")), "counted")
    pairs = _small(pairs.select("model", "target").distinct())
    sides = [counted.join(pairs, F.col("sample") == F.col(side)).select("model", "target", "feature", "value", *[(F.col("n") if c == side else F.lit(0)).cast("long").alias(k) for k, c in (("a", "model"), ("b", "target"))]) for side in ("model", "target")]
    key = ["model", "target", "feature"]
    upto = running(sides[0].unionAll(sides[1]).groupBy(*key, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), key, ["value"], {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))})
    whole = upto.groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("levels"))
    rows = upto.join(_small(materialise(whole, "whole")), [F.col(k) == F.col(f"k_{k}") for k in key])
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    expected = lambda n: (F.col("a") + F.col("b")) * F.col(n) / (F.col("na") + F.col("nb"))
    cell = lambda seen, n: F.try_divide(F.pow(F.col(seen) - expected(n), F.lit(2)), expected(n))
    found = rows.groupBy(*key, "levels").agg(F.max(gap).alias("ks"), F.sum(cell("a", "na") + cell("b", "nb")).alias("chi2"))
    few = F.col("levels") <= CATEGORIES
    return found.select(*key, F.when(few, "chi2").otherwise("ks").alias("kind"), F.when(few, F.col("chi2")).otherwise(F.col("ks")).alias("statistic"), F.when(few & F.col("chi2").isNotNull(), F.col("levels") - 1).cast("int").alias("df"))


def performance_rows(model: str, target: str, d: DataFrame, own: LinearModel, other: LinearModel, score: str = "acces_score", call: str = "acces", label: str = "gs", id_col: str = "id") -> DataFrame:
    """(model, target, metric, value): twelve numbers on the target's table d, by its own model, the other sample's, and score times call."""
    alone = d.select(F.col(id_col).alias("id"), (F.col(score) * F.col(call)).alias("score"), F.col(label).alias("gs"))
    parts = [evaluate(d, m.weights, m.intercept, label, id_col, m.products) for m in (own, other)] + [metrics(alone)]
    rows = [p.select(F.posexplode(F.array(*NUMBERS)).alias("k", "value")).select((F.col("k") + 1 + 4 * i).alias("metric"), "value") for i, p in enumerate(parts)]
    return reduce(DataFrame.unionAll, rows).select(F.lit(model).alias("model"), F.lit(target).alias("target"), "metric", "value")


def _small(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.limit(BROADCAST + 1).count() <= BROADCAST else d


def scores_of_pairs(data: DataFrame, models: DataFrame, pairs: DataFrame, features: list[str], products: bool = False, label: str = "gs", id_col: str = "id") -> DataFrame:
    """(model, target, id, score, gs): the rows of each pair's target under its model.

    data has (sample, id, features ..., gs), models (model, term, weight), a term being a feature, with products the
    product 'a x b' of two in the features' order, or 'intercept'; other terms are left out, and weights of a term add up.
    pairs has (model, target). Values are standardised over the rows of the sample, and those that are the same
    everywhere count 0; null values count 0. A pair without model or rows gives no rows. Rows meet the models of their
    sample by an equi-join, so what comes out is a row a row and model, and the plan is the same for any number of pairs.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in features}
    value |= {f"{a} x {b}": value[a] * value[b] for i, a in enumerate(features) for b in features[i:]} if products else {}
    rows = data.select(F.col("sample"), F.col(id_col).alias("id"), F.col(label).alias("gs"), F.array(*value.values()).alias("x"))
    of = lambda f: F.array(*[f(F.get("x", F.lit(i))) for i in range(len(value))])
    moments = rows.groupBy(F.col("sample").alias("m_sample")).agg(of(F.avg).alias("mean"), of(F.stddev_samp).alias("sd"))
    rows = rows.join(_small(moments), F.col("sample").eqNullSafe(F.col("m_sample")))
    z = F.transform("x", lambda x, i: F.coalesce(F.try_divide(x - F.get("mean", i), F.nullif(F.get("sd", i), F.lit(0.0))), F.lit(0.0)))
    terms = models.groupBy("model", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight")).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w"))
    weight = lambda t: F.coalesce(F.try_element_at("w", F.lit(t)), F.lit(0.0))
    terms = terms.select(F.col("model").alias("t_model"), F.array(*[weight(t) for t in value]).alias("w"), weight(INTERCEPT).alias("c"))
    asked = pairs.select("model", "target").distinct().join(_small(terms), F.col("model").eqNullSafe(F.col("t_model"))).select("model", "target", "w", "c")
    scored = rows.select("sample", "id", "gs", z.alias("z")).join(_small(asked), F.col("sample").eqNullSafe(F.col("target")))
    return scored.select("model", "target", "id", F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.col("c"), lambda a, b: a + b).alias("score"), "gs")


def performance(data: DataFrame, models: DataFrame, pairs: DataFrame, features: list[str], products: bool = False, score: str = "acces_score", call: str = "acces", label: str = "gs", id_col: str = "id") -> DataFrame:
    """(model, target, metric, value): performance_rows() of all pairs (model, target) in one job: twelve numbers on each target's rows, by the target's own model, the pair's model, and score times call.

    data, models and pairs are those of scores_of_pairs(). Each model is evaluated once a target, and a target's own
    model and its score alone once for all its pairs: curves have (model, target) as key. Numbers of models or targets
    that there are no rows of are null. A pair that repeats counts as one.
    """
    pairs = pairs.select("model", "target").distinct()
    evaluated = pairs.unionAll(pairs.select(F.col("target").alias("model"), "target"))
    alone = data.join(_small(pairs.select("target").distinct()), F.col("sample").eqNullSafe(F.col("target"))).select(F.lit(True).alias("alone"), F.lit(None).cast(pairs.schema["model"].dataType).alias("model"), "target", F.col(id_col).alias("id"), (F.col(score) * F.col(call)).cast("double").alias("score"), F.col(label).alias("gs"))
    scored = scores_of_pairs(data, models, evaluated, features, products, label, id_col).select(F.lit(False).alias("alone"), "*").unionAll(alone)
    found = metrics(scored, ["alone", "model", "target"]).select(F.col("alone").alias("f_alone"), F.col("model").alias("f_model"), F.col("target").alias("f_target"), F.array(*NUMBERS).alias("numbers"))
    none = F.lit(None).cast(pairs.schema["model"].dataType)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i == 2).alias("alone"), m.alias("by")) for i, m in enumerate((F.col("target"), F.col("model"), none))])
    rows = pairs.select("model", "target", F.explode(wanted).alias("w")).select("model", "target", "w.*")
    same = (F.col("alone") == F.col("f_alone")) & F.col("by").eqNullSafe(F.col("f_model")) & F.col("target").eqNullSafe(F.col("f_target"))
    rows = rows.join(found, same, "left").withColumn("numbers", F.coalesce("numbers", F.array(*[F.lit(None).cast("double")] * len(NUMBERS))))
    return rows.select("model", "target", (1 + 4 * F.col("i")).alias("first"), F.posexplode("numbers").alias("k", "value")).select("model", "target", (F.col("first") + F.col("k")).alias("metric"), "value")
