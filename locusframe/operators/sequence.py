"""Sequence composition around sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = (0, 100, 400)


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def composition(sequence: Column) -> dict[str, Column]:
    """cpg (CG, Cg, cG but not cg), ratio (observed to expected, -1 without C or G), gc share and repeat class of a soft-masked sequence.

    Class: 5 all N, 4 some N (the other three are null), 3 all lower case, 1 all upper case, 2 mixed.
    """
    n = F.length(sequence).cast("double")
    cpg = _count(sequence, "CG|Cg|cG").cast("double")
    cg = _count(sequence, "[CcGg]").cast("double")
    some_n = _count(sequence, "N") > 0
    kind = F.when(sequence.rlike("^N*$"), 5).when(sequence.rlike("^[acgt]+$"), 3).when(some_n, 4).when(sequence.rlike("^[ACGT]+$"), 1).otherwise(2)
    known = lambda c: F.when(some_n, F.lit(None)).otherwise(c)
    return {"cpg": known(cpg), "ratio": known(F.when(cg == 0, F.lit(-1.0)).otherwise(cpg * n / F.pow(cg / 2, F.lit(2.0)))), "gc": known(F.try_divide(cg, n)), "class": kind}


def sequence_features(sites: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """sites (id, lo, hi, seq): four columns for each window, of seq from lo - window to hi + window, clipped to the sequence."""
    out = [F.col("id")]
    for w in windows:
        lo, hi = F.greatest(F.col("lo") - w, F.lit(1)), F.least(F.col("hi") + w, F.length("seq"))
        part = F.substr(F.col("seq"), lo, F.greatest(hi - lo + 1, F.lit(0)))
        out += [c.alias(f"{k}_{w}") for k, c in composition(part).items()]
    return sites.select(*out)


def with_sequence(sites: DataFrame, chunks: DataFrame, reach: int = max(WINDOWS), piece: int = 4096) -> DataFrame:
    """sites (id, chrom, lo, hi) as (id, lo, hi, seq): the sequence from lo - reach to hi + reach, clipped to the chromosome, with lo and hi counted in it.

    chunks (chrom, start, seq) are parts of chromosomes of any length, from 1, without gaps. Both sides are cut at
    multiples of `piece` bases and joined by (chrom, piece), so no row and no task holds a chromosome. Sites beyond their
    chromosome have an empty sequence.
    """
    bin_of = lambda c: F.floor((c - 1) / F.lit(piece)).cast("long")
    end = F.col("start") + F.length("seq") - 1
    parts = chunks.where(F.length("seq") > 0).select(F.col("chrom").alias("p_chrom"), "start", "seq", end.alias("end"), F.explode(F.sequence(bin_of(F.col("start")), bin_of(end))).alias("p_bin"))
    first, last = F.greatest(F.col("start"), F.col("p_bin") * piece + 1), F.least(F.col("end"), (F.col("p_bin") + 1) * piece)
    parts = parts.select("p_chrom", "p_bin", first.alias("first"), last.alias("last"), F.substr(F.col("seq"), (first - F.col("start") + 1).cast("int"), (last - first + 1).cast("int")).alias("part"))
    s = sites.select("id", "chrom", "lo", "hi", F.greatest(F.lit(1), F.col("lo") - reach).cast("long").alias("a"), (F.col("hi") + reach).cast("long").alias("b"))
    wanted = s.where("a <= b").select("id", "chrom", "a", "b", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("b")))).alias("bin"))
    hit = wanted.join(parts, (F.col("chrom") == F.col("p_chrom")) & (F.col("bin") == F.col("p_bin")) & (F.col("first") <= F.col("b")) & (F.col("last") >= F.col("a")))
    low = F.greatest("first", "a")
    cut = F.substr(F.col("part"), (low - F.col("first") + 1).cast("int"), (F.least("last", "b") - low + 1).cast("int"))
    found = hit.select("id", F.struct(low.alias("at"), cut.alias("cut")).alias("x")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cut"]), "").alias("seq"))  # bounded by the window
    return s.join(found, "id", "left").select("id", (F.col("lo") - F.col("a") + 1).cast("int").alias("lo"), (F.col("hi") - F.col("a") + 1).cast("int").alias("hi"), F.coalesce("seq", F.lit("")).alias("seq"))
