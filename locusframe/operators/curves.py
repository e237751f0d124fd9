"""Precision-recall and ROC curves with distributed ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.operators.scan import along, in_ranges
from locusframe.scratch import materialise


def range_cuts(d: DataFrame, column: str, buckets: int) -> DataFrame:
    """One row: cuts, ascending values that deal the rows of d to about `buckets` ranges of like size."""
    return d.agg(F.percentile_approx(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(10_000)).alias("cuts"))


#: The four numbers of a curve, and how many keys' totals are broadcast.
NUMBERS, BROADCAST_KEYS = ("aupr", "rec10", "auroc", "fpr1"), 500_000


def _steps(scored: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, rank, hits, gs, n, p): a row a step by falling score, ties by id; hits so far, and the key's rows and hits.

    The input is evaluated once, to a narrow table. Ranks and hits are prefix sums over ranges of (keys, score, id), so
    neither a key nor a score that all rows have is one task's work, whatever the id is.
    """
    rows = materialise(scored.select(*keys, "id", "score", "gs"), "scored")
    placed = in_ranges(rows, [*keys, F.col("score").desc(), F.col("id")], [*keys, "gs"], "ranked", parts=ranges)
    steps = along(placed, keys, {"rank": ("sum", F.lit(1).cast("long")), "hits": ("sum", F.col("gs").cast("long"))}, [*keys, "gs"])
    totals = placed.groupBy(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"), F.sum("gs").alias("p"))
    if not keys:
        return steps.crossJoin(F.broadcast(totals))  # one row
    same = [F.col(k).eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate(keys)]
    few = totals.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return steps.join(F.broadcast(totals) if few else totals, reduce(lambda a, b: a & b, same))


def _point(rank: Column, hits: Column) -> dict[str, Column]:
    return {"prec": hits / rank, "rec": F.try_divide(hits, F.col("p")), "fpr": F.try_divide(rank - hits, F.col("n") - F.col("p"))}


def curve(scored: DataFrame, ranges: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, rank, prec, rec, fpr) for scored (keys, id, score, gs): one step a row, by falling score (null last), ties by id, and one curve a key. Rows are dealt to so many ranges, by default as many as shuffles have."""
    return _steps(scored, keys or [], ranges).select(*(keys or []), "rank", *[c.alias(k) for k, c in _point(F.col("rank"), F.col("hits")).items()])


def area(points: DataFrame, x: str, y: str, rank: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """(keys, area): the trapezoid rule over points in rank order, each key's own.

    Steps inside a range of ranks are summed up there; those from one range to the next come from their ends, a row a
    range and key.
    """
    keys = keys or []
    rows = in_ranges(points.select(*keys, rank, F.col(x).alias("x"), F.col(y).alias("y")), [*keys, rank], [*keys, "x", "y"], "points")
    step = lambda w: (F.col("x") - F.lag(F.col("x")).over(w)) * (F.col("y") + F.lag(F.col("y")).over(w)) / 2
    inside = rows.select(*keys, step(W.partitionBy("__part", *keys).orderBy("__at")).alias("s")).groupBy(*keys).agg(F.sum("s").alias("s"))
    ends = rows.groupBy("__part", *keys).agg(F.min_by(F.struct("x", "y"), "__at").alias("a"), F.max_by(F.struct("x", "y"), "__at").alias("b"))
    line = W.partitionBy(*keys).orderBy("__part")
    before = F.lag("b").over(line)
    between = ends.select(*keys, ((F.col("a")["x"] - before["x"]) * (F.col("a")["y"] + before["y"]) / 2).alias("s"))
    return inside.unionAll(between).groupBy(*keys).agg(F.sum("s").alias("area"))


def metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, aupr, rec10, auroc, fpr1), one row a key: rec10 is the mean precision where 0.05 <= recall < 0.15, fpr1 the mean recall where 0.005 <= false positive rate < 0.015; null where no step falls there.

    The curve starts at (recall 0, the first precision) and (false positive rate 0, recall 0). The step before a row is
    known from the row, so the areas are plain sums.
    """
    now = _point(F.col("rank"), F.col("hits"))
    before = _point(F.col("rank") - 1, F.col("hits") - F.col("gs"))
    first = F.col("rank") == 1
    start = {"prec": now["prec"], "rec": F.lit(0.0), "fpr": F.lit(0.0)}
    before = {k: F.when(first, start[k]).otherwise(c) for k, c in (before | {"prec": F.try_divide(F.col("hits") - F.col("gs"), F.col("rank") - 1)}).items()}
    slab = lambda x, y: F.sum((now[x] - before[x]) * (now[y] + before[y]) / 2)
    mean = lambda c, at, lo, hi: F.avg(F.when((now[at] >= lo) & (now[at] < hi), now[c]))
    found = [slab("rec", "prec"), mean("prec", "rec", 0.05, 0.15), slab("fpr", "rec"), mean("rec", "fpr", 0.005, 0.015)]
    return _steps(scored, keys or []).groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in zip(NUMBERS, found, strict=True)])


def evaluate(d: DataFrame, weights: dict[str, float], intercept: float, label: str = "gs", id_col: str = "id", products: bool = False) -> DataFrame:
    """metrics() of a linear model on d: its columns, or with products their pairwise products too, standardised over d, then weighted. A column that is the same everywhere counts 0."""
    columns = [c for c in weights if " x " not in c]
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    value |= {f"{a} x {b}": value[a] * value[b] for i, a in enumerate(columns) for b in columns[i:]} if products else {}
    used = [c for c in weights if c in value]
    whole = d.agg(*[f(value[c]).alias(f"__{k}{i}") for i, c in enumerate(used) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    # One expression for the score: standardised columns of their own would be many, and Spark infers constraints for each.
    scaled = [F.coalesce(F.try_divide(value[c] - F.col(f"__m{i}"), F.nullif(F.col(f"__s{i}"), F.lit(0.0))), F.lit(0.0)) * F.lit(float(weights[c])) for i, c in enumerate(used)]
    score = reduce(lambda a, b: a + b, scaled, F.lit(float(intercept)))
    return metrics(d.crossJoin(F.broadcast(whole)).select(F.col(id_col).alias("id"), score.alias("score"), F.col(label).alias("gs")))  # one row
