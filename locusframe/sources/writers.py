"""Sinks: track caches, score tables, cut alignments, pair matrices and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def track_cache(track: DataFrame, path: str) -> None:
    """A track as Parquet by chromosome, sorted by position; values as floats, as they are read back."""
    order = next(c for c in ("pos", "start0", "lo") if c in track.columns)
    track.withColumn("val", F.col("val").cast("float")).repartitionByRange("chrom", order).sortWithinPartitions("chrom", order).write.partitionBy("chrom").parquet(path)


def read_track(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("val", F.col("val").cast("double"))


def score_table(scores: DataFrame, path: str, id_col: str = "motif_id") -> None:
    """Gzipped tab-separated rows in id order over the files; nulls as NA."""
    scores.repartitionByRange(id_col).sortWithinPartitions(id_col).write.csv(path, sep="\t", compression="gzip", nullValue="NA")


def cut_sites(cuts: DataFrame, path: str, by_strand: bool = False) -> None:
    """Cut sites, with whatever columns of their reads cuts has, in coordinate order; in a folder for each strand if asked for."""
    rows = cuts.repartitionByRange("rname", "cut").sortWithinPartitions("rname", "cut").write
    (rows.partitionBy("strand") if by_strand else rows).parquet(path)


def pair_matrix(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("append").partitionBy("model").parquet(path)


def predictions(scored: DataFrame, path: str) -> None:
    """chrom, lo, hi and z-score as tab-separated text."""
    scored.select("chrom", "lo", "hi", "score").write.csv(path, sep="\t")
