"""Temperature mixing of sources: exponentiated token shares, and budgets realised as block permutations of whole epochs."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm.common import materialise

#: Rows of one sorted bucket, about; sections of the exponent tried in one pass; rows of budgets and of bucket sums that are broadcast.
BUCKET_ROWS, SECTIONS, BROADCAST_SOURCES = 5_000, 64, 200_000


def n_tokens(text: str = "text") -> Column:
    """Words of a whole text, 1 at least."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(1).cast("long"))


def repetition_exponent(least: int, most: int, limit: float) -> float:
    """The smallest exponent in [0, 1] by which the smallest source is repeated at most limit times as often as the largest."""
    lo, hi = 0.0, 1.0  # at 1 every source has one epoch
    if least >= most or (most / least) ** (1 - lo) <= limit:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (most / least) ** (1 - mid) <= limit else (mid, hi)
    return hi


def entropy_exponent(sources: DataFrame, target: float) -> float:
    """The exponent in [0, 1] whose weights have this entropy (nats); the nearest end if none has. Each pass tries SECTIONS exponents, and keeps one section."""
    lo, hi = 0.0, 1.0
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total)))
    for _ in range(5):
        tried = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        cells = []
        for i, a in enumerate(tried):
            cells += [F.sum(F.exp(share * a)).alias(f"z{i}"), F.sum(F.exp(share * a) * share * a).alias(f"x{i}")]
        r = sources.agg(*cells).first()
        entropy = [log(r[f"z{i}"]) - r[f"x{i}"] / r[f"z{i}"] for i in range(len(tried))]  # falls as the exponent grows
        if target >= entropy[0]:
            return tried[0]
        if target <= entropy[-1]:
            return tried[-1]
        i = max(k for k, e in enumerate(entropy) if e >= target)
        lo, hi = tried[i], tried[min(i + 1, SECTIONS)]
    return (lo + hi) / 2


def mix(
    df: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1_000_000,
    seed: int = 17, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: for each copy of a row that the budgets take, the columns in keep (default: the id), and source, n_tokens, epoch, block, slot.

    Weights are token shares to an exponent, found for the target entropy if given, else for the repetition limit: how
    many times as often the smallest source may repeat as the largest. The budget is budget_tokens, or without it the
    least that takes every row once. A source's budget is as many whole epochs as fit and the rows with the smallest
    hash (seed, id, text) that fit into the rest.

    Each epoch of a source is a permutation by hash. The blocks, of about block_tokens, have equal shares of each
    source's budget: a copy belongs to the block in which its first token falls when the source's copies stand in order,
    so a block has the tokens of a source that its weight gives it, but for the document at each end. slot is the copy's
    place in its block, from 0, in an order by hash. Rows come in ranges of blocks, ordered by block and slot.

    A row has its words as tokens, 1 at least, so null and empty texts take part. Null sources are one source. Repeated
    rows are taken or left together. Null ids are rows like any other. Columns in keep may not be named like the
    results, which win. An empty df gives an empty result. What keep names is shuffled twice, by bucket of a source and
    by block; no other text is.
    """
    results = ["source", "n_tokens", "epoch", "block", "slot"]
    keep = [c for c in keep or [id_col] if c not in results]
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    narrow = materialise(df.select(F.col(source_col).alias("source"), n_tokens(text_col).alias("tokens"), hashed.alias("h")), "tokens")
    sources = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    sources = materialise(sources, "sources")
    ends = sources.agg(F.min("tokens").alias("a"), F.max("tokens").alias("b"), F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if target_entropy is not None:
        exponent = entropy_exponent(sources, target_entropy)
    else:
        exponent = repetition_exponent(ends.a or 1, ends.b or 1, repetition_limit or 1.0)
    raw = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    norm = sources.agg(F.sum(raw).alias("z"), F.max(F.col("tokens") / raw).alias("cover")).first()
    scale = (budget_tokens / norm.z if budget_tokens else norm.cover) if norm.z else 0.0  # tokens a source gets for its raw weight
    budget = F.floor(raw * F.lit(float(scale)) + 1e-6).cast("long")
    plan = sources.select(F.col("source").alias("p_source"), F.col("tokens").alias("total"), F.col("rows").alias("rows"), budget.alias("budget")).withColumn("whole", F.floor(F.col("budget") / F.col("total")).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("total"))
    few = ends.n <= BROADCAST_SOURCES
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)

    # The last, partial epoch: the largest hash up to which rows fit, from sums of buckets by hash and running sums in each.
    unit = (F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53))).cast("double")
    part = narrow.join(small(plan.where("rest > 0")), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("u", unit)
    part = part.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("rows") / BUCKET_ROWS))).select("source", "bucket", "u", "h", "tokens", "rest")
    sums = part.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    running = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("u", "h"))  # rows of equal hash together
    placed = part.withColumn("upto", running).join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    cut = placed.where(F.col("before") + F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("u", "h")).alias("cut")).select(F.col("source").alias("c_source"), "cut")
    plan = materialise(plan.join(cut, F.col("p_source").eqNullSafe(F.col("c_source")), "left").select("p_source", "rows", "budget", "whole", "cut"), "budgets")

    blocks = max(1, ceil(scale * (norm.z or 0) / block_tokens))
    # Tokens of a source before each bucket of its copies, from a narrow pass.
    def copied(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("u", unit).join(small(plan), F.col("source").eqNullSafe(F.col("p_source")))
        copies = F.col("whole") + F.coalesce((F.struct("u", "h") <= F.col("cut")).cast("int"), F.lit(0))
        rows = rows.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
        # Epoch 0 keeps the order of the hash; later ones permute anew.
        again = F.when(F.col("epoch") == 0, F.col("u")).otherwise((F.shiftrightunsigned(F.xxhash64("h", "epoch"), 11) / F.lit(float(1 << 53))).cast("double"))
        return rows.withColumn("order", again).withColumn("bucket", F.floor(F.col("order") * F.ceil(F.col("rows") / BUCKET_ROWS)))

    sums = copied(narrow).groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    line = W.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(W.unboundedPreceding, -1)
    before = materialise(sums.select(F.col("source").alias("b_source"), F.col("epoch").alias("b_epoch"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")), "before")
    rows = copied(df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(source_col).alias("source"), n_tokens(text_col).alias("tokens"), hashed.alias("h")))
    inside = F.sum("tokens").over(W.partitionBy("source", "epoch", "bucket").orderBy("order", "h").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    rows = rows.select(*[f"__k{i}" for i in range(len(keep))], "source", "tokens", "h", "epoch", "bucket", "budget", inside.alias("inside"))
    few = before.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(before) if few else before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("bucket") == F.col("b_bucket")))
    at = (F.col("before") + F.col("inside")) / F.greatest("budget", F.lit(1).cast("long"))
    rows = rows.withColumn("block", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long"))
    order = [F.xxhash64("h", "epoch", F.lit("slot")), F.col("h"), F.col("epoch")]
    slot = F.row_number().over(W.partitionBy("block").orderBy(*order)) - 1
    # A sort of its own, which the window takes over: rows keep their order if nobody asks for slot.
    out = rows.repartitionByRange("block").sortWithinPartitions("block", *order).withColumn("slot", slot.cast("long"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "source", F.col("tokens").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"), "block", "slot")
