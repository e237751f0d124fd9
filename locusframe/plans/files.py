"""Queries that write the test projections in each file format to the shared folder and read them back, with the SQL of what has to come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.operators import reads as read_ops
from locusframe.plans.queries import ORACLES, QUERIES, query
from locusframe.scratch import shared_dir
from locusframe.sources import bigwig, readers, writers
from locusframe.sources.bam import bam, bam_region, write_bam
from locusframe.sources.parts import named_texts
from locusframe.testbed import view, with_views


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(lines: DataFrame, name: str, *columns: str, compression: str = "none") -> str:
    """The columns as tab-separated lines in a new folder."""
    path = _path(lines.sparkSession, name)
    lines.selectExpr(f"concat_ws('\t', {', '.join(columns)}) as value").write.text(path, compression=compression)
    return path


def _blocks(rows: DataFrame, header: str, line: str, key: list[str], order: str, name: str) -> str:
    """One header line for each key, then its lines in order; a key stays in one file, and a file has many.

    The header comes with the key's first line: a table of headers joined by a union may be dealt to other tasks than the lines.
    """
    first = F.row_number().over(W.partitionBy(*key).orderBy("o")) == 1
    rows = rows.withColumn("o", F.expr(f"cast({order} as long)")).withColumn("first", first).sortWithinPartitions(*key, "o")
    path = _path(rows.sparkSession, name)
    # Lines are made after the sort, which so holds what they are made of and no header.
    rows.select(F.explode(F.when(F.col("first"), F.array(F.expr(header), F.expr(line))).otherwise(F.array(F.expr(line)))).alias("value")).write.text(path)
    return path


@query(with_views("select cast(motif_id as varchar) as name, chrom, st as lo, en as hi, score, strand from motifs", "motifs"))
def file_bed_sites(spark: SparkSession, d: str) -> DataFrame:
    path = _text(view(spark, d, "motifs"), "bed", "chrom", "st", "en", "motif_id", "score", "strand", compression="gzip")
    return readers.bed_sites(spark, path).select("name", "chrom", "lo", "hi", "score", "strand")


@query(with_views("select chrom, tx_start as lo, tx_end as hi from transcripts", "transcripts"))
def file_gff_ranges(spark: SparkSession, d: str) -> DataFrame:
    path = _text(view(spark, d, "transcripts"), "gff", "chrom", "'src'", "'gene'", "tx_start", "tx_end", "'.'", "strand")
    return readers.gff_ranges(spark, path)


@query(with_views("select chrom, pos, cast(cast(val as float) as double) as val from signal", "signal"))
def file_variable_step(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "signal").withColumn("piece", F.expr("pos div 4096"))  # a chromosome is many blocks, as no task has to write it all
    path = _blocks(rows, "concat('variableStep chrom=', chrom)", "concat(pos, '\t', val)", ["chrom", "piece"], "pos", "variable")
    return readers.variable_step(spark, path)


@query(with_views("select chrom, block_start, pos, val from blocks", "blocks"))
def file_fixed_step(spark: SparkSession, d: str) -> DataFrame:
    path = _blocks(view(spark, d, "blocks"), "concat('fixedStep chrom=', chrom, ' start=', block_start, ' step=1')", "cast(val as string)", ["chrom", "block_start"], "pos", "fixed")
    return readers.fixed_step(spark, path)


@query(with_views("select chrom, start0, end0, cast(cast(val as float) as double) as val from maptrack", "maptrack"))
def file_bed_graph(spark: SparkSession, d: str) -> DataFrame:
    return readers.bed_graph(spark, _text(view(spark, d, "maptrack"), "bedgraph", "chrom", "start0", "end0", "val"))


@query(with_views("select chrom, start0, end0, cast(cast(val as float) as double) as val from maptrack", "maptrack"))
def file_bed6_values(spark: SparkSession, d: str) -> DataFrame:
    return readers.bed6_values(spark, _text(view(spark, d, "maptrack"), "bed6", "chrom", "start0", "end0", "'n'", "val", "'+'"))


@query(with_views("select chrom, start0 + 1 as lo, end0 as hi, max(name) as name from exclusion group by 1, 2, 3", "exclusion"))
def file_bed6_annotations(spark: SparkSession, d: str) -> DataFrame:
    # Of rows with one interval the last one counts, so the file is in order of the names.
    rows = view(spark, d, "exclusion").orderBy("name").coalesce(1)
    return readers.bed6_annotations(spark, _text(rows, "annotations", "chrom", "start0", "end0", "name", "0", "strand")).select("chrom", "lo", "hi", "name")


@query(with_views("select chrom, start0 + 1 as lo, end0 as hi, max(cast(cast(val as varchar) as double)) as val from maptrack group by 1, 2, 3", "maptrack"))
def file_bed4_annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "maptrack").orderBy("val").coalesce(1)
    return readers.bed4_annotations(spark, _text(rows, "scores", "chrom", "start0", "end0", "val")).select("chrom", "lo", "hi", "val")


@query(with_views("select tx, chrom, strand, tx_start, tx_end, gene from transcripts", "transcripts"))
def file_gene_table(spark: SparkSession, d: str) -> DataFrame:
    path = _text(view(spark, d, "transcripts"), "genes", "0", "tx", "chrom", "strand", "tx_start", "tx_end", *["'x'"] * 6, "gene")
    return readers.ref_gene(spark, path).drop("file_row")


@query(with_views("select chrom, length(seq) as bases, md5(seq) as md5 from (select chrom, string_agg(seq, '' order by start) as seq from genome group by 1) where seq <> ''", "genome"))
def file_sequences(spark: SparkSession, d: str) -> DataFrame:
    path = _blocks(view(spark, d, "genome").where("seq != ''"), "concat('>', chrom, ' test')", "seq", ["chrom"], "start", "fasta")
    return readers.fasta(spark, path).select("chrom", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("md5"))


@query(with_views("select chrom, cast(max(start + length(seq) - 1) as bigint) as length from genome where seq <> '' group by 1", "genome"))
def file_chromosome_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = view(spark, d, "genome").where("seq != ''").groupBy("chrom").agg(F.max(F.expr("start + length(seq) - 1")).alias("size"))
    return readers.chrom_sizes(spark, _text(sizes, "sizes", "concat(chrom, '   ', size)"))


@query(with_views("select motif_id, case when motif_id % 7 = 0 then null else cast(st as double) end as a, score as b from motifs", "motifs"))
def file_score_table(spark: SparkSession, d: str) -> DataFrame:
    """The sink writes gzipped rows in order with NA for null."""
    rows = view(spark, d, "motifs").selectExpr("motif_id", "if(motif_id % 7 = 0, null, cast(st as double)) as a", "score as b")
    path = _path(spark, "table")
    writers.score_table(rows, path)
    return readers.score_table(spark, path, ["motif_id", "a", "b"]).select(F.col("motif_id").cast("long").alias("motif_id"), "a", "b")


@query(with_views("select st, en, case when motif_id % 3 > 0 and st % 2 > 0 then 1 else 0 end as gs from motifs", "motifs"))
def file_gold_standard(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "motifs").orderBy("motif_id").coalesce(1)
    keep = view(spark, d, "motifs").selectExpr("row_number() over (order by motif_id) as n", "st", "en")
    gold = readers.gold_standard(spark, _text(rows, "gold", "motif_id % 3", "st % 2"))
    return gold.join(keep, F.col("line") == F.col("n")).select("st", "en", "gs")


@query(with_views("select file_row, rname, flag, pos, mapq, rlen from reads where is_dup = 0", "reads"))
def file_alignments(spark: SparkSession, d: str) -> DataFrame:
    """A text alignment file; the flag holds whether a read is marked as a duplicate."""
    r = view(spark, d, "reads").withColumn("full", F.expr("flag | if(is_dup = 1, 1024, 0)"))
    path = _text(r, "sam", "file_row", "full", "rname", "pos + 1", "mapq", "'36M'", "'='", "0", "0", "repeat('A', rlen)", "repeat('I', rlen)")
    return readers.sam(spark, path).where("not is_dup").select(F.col("qname").cast("long").alias("file_row"), "rname", "flag", "pos", "mapq", "rlen")


@query(with_views("select chrom, pos, cast(cast(val as float) as double) as val from signal", "signal"))
def track_cache_points(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "points")
    writers.track_cache(view(spark, d, "signal").withColumn("val", F.col("val").cast("double")), path)
    return writers.read_track(spark, path).select("chrom", "pos", "val")


@query(with_views("select chrom, block_start, pos, cast(cast(val as float) as double) as val from blocks", "blocks"))
def track_cache_blocks(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "blocks")
    writers.track_cache(view(spark, d, "blocks"), path)
    return writers.read_track(spark, path).select("chrom", "block_start", "pos", "val")


@query(with_views("select chrom, start0, end0, cast(cast(val as float) as double) as val from maptrack", "maptrack"))
def track_cache_intervals(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "intervals")
    writers.track_cache(view(spark, d, "maptrack"), path)
    return writers.read_track(spark, path).select("chrom", "start0", "end0", "val")


@query(with_views("select rname, strand, cut, count(*) as n from (select rname, pos + case when flag in (83, 147) then rlen - 5 else 4 end as cut, case when flag in (83, 147) then '-' else '+' end as strand from reads where mapq >= 30 and is_dup = 0 and flag in (83, 147, 163, 99) qualify row_number() over (partition by rname, pos, flag order by file_row) <= 50) group by 1, 2, 3", "reads"))
def cut_site_files(spark: SparkSession, d: str) -> DataFrame:
    """Cut sites by strand in coordinate order, read back and counted."""
    path = _path(spark, "cuts")
    writers.cut_sites(read_ops.paired_cuts(view(spark, d, "reads")), path, by_strand=True)
    return spark.read.parquet(path).groupBy("rname", "strand", "cut").agg(F.count("*").alias("n"))


_ALIGNED = ["concat('read', cast(file_row as varchar(9))) as qname", "rname", "cast(flag + is_dup * 1024 as int) as flag", "cast(pos as int) as pos", "cast(mapq as int) as mapq", "rlen"]


def _bam(spark: SparkSession, d: str) -> str:
    """Alignments of the reads as a folder of sorted, indexed BAM files."""
    path = _path(spark, "bam")
    reads = view(spark, d, "reads").selectExpr(*_ALIGNED, "repeat('ACGT', 9) as seq", "repeat('I', 36) as qual", "-1 as pnext", "0 as tlen")
    write_bam(reads, path, [("chr1", 60_000), ("chr2", 60_000)])
    return path


@query(with_views(f"select {', '.join(_ALIGNED)} from reads", "reads"))
def file_bam(spark: SparkSession, d: str) -> DataFrame:
    return bam(spark, f"{_bam(spark, d)}/*.bam").select("qname", "rname", "flag", "pos", "mapq", "rlen")


@query(with_views("select rname, flag, pos, count(*) as n from (select rname, cast(flag + is_dup * 1024 as int) as flag, cast(pos as int) as pos from reads) r where rname = 'chr2' and pos < 120 and pos + 36 > 110 group by 1, 2, 3", "reads"))
def bam_region_reads(spark: SparkSession, d: str) -> DataFrame:
    return bam_region(spark, _bam(spark, d), "chr2", 110, 120).groupBy("rname", "flag", "pos").agg(F.count("*").alias("n"))


@query(with_views("select chrom, start0, end0, cast(cast(val as float) as double) as val from maptrack", "maptrack"))
def file_big_wig(spark: SparkSession, d: str) -> DataFrame:
    return bigwig.big_wig(spark, f"{_big_wig(spark, d)}/*.bw")


@query(with_views("select chrom, start0, end0, cast(cast(val as float) as double) as val from maptrack where chrom = 'chr2' and start0 < 3000 and end0 > 1000", "maptrack"))
def big_wig_region(spark: SparkSession, d: str) -> DataFrame:
    return bigwig.big_wig(spark, f"{_big_wig(spark, d)}/*.bw", "chr2", 1000, 3000)


def _big_wig(spark: SparkSession, d: str) -> str:
    track, path = view(spark, d, "maptrack"), _path(spark, "bigwig")
    bigwig.write_big_wig(track, path, [tuple(r) for r in track.groupBy("chrom").agg(F.max("end0")).collect()])  # a row a chromosome
    return path


@query(with_views("select 'OCT' as tf, cast(motif_id as varchar) as name, chrom, st as lo, en as hi, score, strand from motifs where chrom = 'chr2' and motif_id % 3 = 1", "motifs"))
def file_sites_of_chromosome(spark: SparkSession, d: str) -> DataFrame:
    """Sites in files named by factor and chromosome, some of each; those of one factor and chromosome are opened."""
    line = "concat_ws('\t', chrom, st, en, motif_id, score, strand) as value"
    rows = view(spark, d, "motifs").selectExpr("concat(pmod(xxhash64(motif_id), 8), '/', element_at(array('CTCF', 'OCT', 'SOX'), cast(motif_id % 3 + 1 as int)), chrom, '.bed.gz') as name", "motif_id as at", line)
    path = _path(spark, "sites")
    named_texts(rows, path)
    return readers.bed_sites(spark, f"{path}/*/", "chr2", "OCT").select("tf", "name", "chrom", "lo", "hi", "score", "strand")


#: Cells that stand for the samples of pairs, by the length of a name.
_CELL = "case length({0}) % 3 when 0 then 'K562' when 1 then 'HepG2' else 'GM12878' end"
_SAMPLE = "concat(upper(replace({0}, ' ', '_')), " + _CELL + ")"


def _pair_files(spark: SparkSession, d: str) -> str:
    """A performance file for each pair: a header, and a line a metric."""
    rows = view(spark, d, "pairs_y").selectExpr(f"concat({_SAMPLE.format('model')}, {_SAMPLE.format('target')}, 'x4.txt') as name", "metric as at", "concat('\"m', metric, '\" ', value) as value")
    heads = rows.select("name").distinct().selectExpr("name", "cast(0 as long) as at", "'\"x\"' as value")
    path = _path(spark, "pairs")
    named_texts(rows.withColumn("at", F.col("at").cast("long")).unionByName(heads), path)
    return path


@query(with_views(f"select {_SAMPLE.format('model')} as model, {_SAMPLE.format('target')} as target, cast(row_number() over (partition by model, target order by metric) as int) as row, concat('m', metric) as name, value from pairs_y", "pairs_y"))
def file_pair_tables(spark: SparkSession, d: str) -> DataFrame:
    return readers.pair_tables(spark, _pair_files(spark, d), ["K562", "HepG2", "GM12878"])


@query(with_views(f"select distinct upper(replace(model, ' ', '_')) as model_tf, {_CELL.format('model')} as model_cell, upper(replace(target, ' ', '_')) as target_tf, {_CELL.format('target')} as target_cell, model = target as diagonal from pairs_y", "pairs_y"))
def pair_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Factors and cells of the samples of pairs, from the names of their files."""
    files = spark.read.format("binaryFile").load(_pair_files(spark, d) + "/*x4.txt").select(F.element_at(F.split("path", "/"), -1).alias("base"))
    return files.select(*[c.alias(k) for k, c in readers.pair_names(F.col("base"), ["K562", "HepG2", "GM12878"], r"x4\.txt").items()])


@query(with_views("select model, target, metric, value from pairs_y", "pairs_y"))
def pair_matrix_files(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "pairs")
    writers.pair_matrix(view(spark, d, "pairs_y"), path)
    return spark.read.parquet(path).select("model", "target", "metric", "value")


@query(with_views("select chrom, st as lo, en as hi, score from motifs", "motifs"))
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "predictions")
    writers.predictions(view(spark, d, "motifs").selectExpr("chrom", "st as lo", "en as hi", "score"), path)
    return spark.read.csv(path, sep="\t", schema="chrom string, lo long, hi long, score double")


__all__ = ["ORACLES", "QUERIES"]
