"""Read-level operators: cut sites, duplicate counts, shifts and pileups. Positions are 0-based as in alignment files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Flags of properly paired reads on the minus and the plus strand.
MINUS, PLUS = (83, 147), (163, 99)


def _capped(rows: DataFrame, cap: int) -> DataFrame:
    """The first cap rows of each (rname, pos, flag) in file order."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("rname", "pos", "flag").orderBy("file_row"))).where(F.col("nth") <= cap).drop("nth")


def paired_cuts(reads: DataFrame, min_mapq: int = 30, cap: int = 50) -> DataFrame:
    """(file_row, rname, flag, cut, strand) of properly paired reads: pos + rlen - 5 on minus, pos + 4 on plus; base, mate and template length too if given."""
    kept = _capped(reads.where((F.col("mapq") >= min_mapq) & ~F.col("is_dup").cast("boolean") & F.col("flag").isin(*MINUS, *PLUS)), cap)
    minus = F.col("flag").isin(*MINUS)
    offset = F.when(minus, F.col("rlen") - 5).otherwise(F.lit(4))
    out = ["file_row", "rname", "flag", (F.col("pos") + offset).alias("cut"), F.when(minus, "-").otherwise("+").alias("strand")]
    if "seq" in reads.columns:
        out.append(F.substr("seq", offset + 1, F.lit(1)).alias("base"))
    if "pnext" in reads.columns:
        out.append((F.col("pnext") + F.when(minus, F.lit(4)).otherwise(F.col("rlen") - 5)).alias("mate_cut"))
    if "tlen" in reads.columns:
        out.append(F.when(minus, -F.abs("tlen")).otherwise(F.abs("tlen")).alias("tlen"))
    return kept.select(*out)


def single_cuts(reads: DataFrame, min_mapq: int = 25, cap: int = 50, minus_flag: int = 16, plus_flag: int = 0) -> DataFrame:
    """(file_row, rname, flag, cut, strand) of single reads: the last base on minus, the first on plus, without a shift."""
    kept = _capped(reads.where((F.col("mapq") >= min_mapq) & ~F.col("is_dup").cast("boolean") & F.col("flag").isin(minus_flag, plus_flag)), cap)
    minus = F.col("flag") == minus_flag
    return kept.select("file_row", "rname", "flag", (F.col("pos") + F.when(minus, F.col("rlen") - 1).otherwise(0)).alias("cut"), F.when(minus, "-").otherwise("+").alias("strand"))


def duplicate_counts(reads: DataFrame, min_mapq: int = 30, minus: tuple[int, ...] = MINUS, plus: tuple[int, ...] = PLUS) -> DataFrame:
    """(rname, cut, n): cut positions and how many reads share each; by default of paired reads."""
    back = F.col("flag").isin(*minus)
    kept = reads.where((F.col("mapq") >= min_mapq) & F.col("flag").isin(*minus, *plus))
    return kept.groupBy("rname", (F.col("pos") + F.when(back, F.col("rlen") - 5).otherwise(4)).alias("cut")).agg(F.count("*").alias("n"))


def single_duplicate_counts(reads: DataFrame, min_mapq: int = 20, minus_flag: int = 16, plus_flag: int = 0) -> DataFrame:
    """duplicate_counts() of single reads, without those marked as duplicates (is_dup)."""
    return duplicate_counts(reads.where(F.col("is_dup").cast("int") == 0), min_mapq, (minus_flag,), (plus_flag,))


def shifted(reads: DataFrame, above_mapq: int = 30) -> DataFrame:
    """(file_row, rname, flag, pos) of whole properly paired reads above a mapping quality, moved like their cuts; other reads are left out."""
    minus = F.col("flag").isin(*MINUS)
    kept = reads.where((F.col("mapq") > above_mapq) & F.col("flag").isin(*MINUS, *PLUS))
    return kept.select("file_row", "rname", "flag", (F.col("pos") + F.when(minus, F.lit(-5)).otherwise(F.lit(4))).alias("pos"))


def pileup(cuts: DataFrame) -> DataFrame:
    """(chrom, pos, val): cuts per base, 1-based, as a signal."""
    return cuts.groupBy(F.col("rname").alias("chrom"), (F.col("cut") + 1).alias("pos")).agg(F.count("*").alias("val"))
