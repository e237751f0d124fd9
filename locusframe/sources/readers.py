"""Readers of the field's text and binary formats, as DataFrames with explicit row ids.

Text lines keep the order of the file in `line`, which holds within a file. Files are read in splits; line numbers, headers
and positions are carried from split to split by small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.sources.bam import BamSource, bam  # noqa: F401  the reader of the binary format

#: Bytes of text that one task sorts, about; lines of a split that go to one task together.
TASK_BYTES, PIECE_LINES = 8 << 20, 1 << 14


def _lines(spark: SparkSession, path: str | list[str], names: str | None = None) -> DataFrame:
    """(file, split, at, value): lines with their file, the offset of their split in it, and a number that grows along each split; only of files whose name fits the pattern, if given, as others aren't opened."""
    reader = spark.read if names is None else spark.read.option("pathGlobFilter", names)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _before(splits: DataFrame, value: Column) -> Column:
    """The sum of value over a file's splits before each; splits has one row a split."""
    return F.coalesce(F.sum(value).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str | list[str], names: str | None = None) -> DataFrame:
    """(file, line, value): lines with their number in the file; gz and bz2 files are read too.

    Numbers run along each split from the lines counted in the splits before, so no file is sorted or read by one task
    unless its compression needs that.
    """
    lines = _lines(spark, path, names)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("base"))
    splits = splits.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), (_before(splits, F.col("n")) - F.col("base") + 1).alias("add"))
    return lines.join(splits, (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split"))).select("file", (F.col("at") + F.col("add")).alias("line"), "value")


def _tasks(spark: SparkSession, path: str | list[str]) -> int:
    """How many tasks of about TASK_BYTES of text the files make, at least one a core; only the files' lengths are read."""
    length = F.col("length") * F.when(F.col("path").rlike(r"\.(gz|bz2)$"), 8).otherwise(1)
    text = spark.read.format("binaryFile").load(path).agg(F.sum(length)).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-text // TASK_BYTES))


def _under_headers(spark: SparkSession, path: str | list[str], header: Column, size: Column | None = None) -> DataFrame:
    """(file, split, header, place, value): lines that aren't blank nor headers, under the last header above them, with the sum of `size` (1 a line by default) over the lines since. file is a hash of the name.

    Headers and sums are carried along pieces of PIECE_LINES lines of a split, and from piece to piece in a small table; so
    a block or a split may be longer than any row or task, and tasks are as many as the text needs.
    """
    lines = _lines(spark, path).where(F.trim("value") != "").select(F.xxhash64("file").alias("file"), "split", F.expr(f"at div {PIECE_LINES}").alias("piece"), "at", "value")
    key = ["file", "split", "piece"]
    # What is made of a line comes after the sort, so that rows are short there.
    lines = lines.repartition(_tasks(spark, path), *key).sortWithinPartitions(*key, "at")
    rows = lines.withColumn("header", header).withColumn("size", F.when(F.col("header").isNull(), F.lit(1).cast("long") if size is None else size.cast("long")).otherwise(0))
    along = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("own", F.last("header", True).over(along)).withColumn("upto", F.sum("size").over(along))
    rows = rows.withColumn("since", F.coalesce(F.last(F.when(F.col("header").isNotNull(), F.col("upto")), True).over(along), F.lit(0)))
    # Of each piece: its last header, and the size of what stands under it, or of the whole piece without one.
    ends = rows.groupBy(*key).agg(F.max_by("own", "at").alias("own"), (F.max("upto") - F.max("since")).alias("tail"))
    before = W.partitionBy("file").orderBy("split", "piece").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("upto", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # What stands before a piece under the header carried into it: the tails since the piece of that header, its own included.
    since = F.coalesce(F.last(F.when(F.col("own").isNotNull(), F.col("upto")), True).over(before), F.lit(0))
    carried = ends.select(*[F.col(k).alias(f"e_{k}") for k in key], F.last("own", True).over(before).alias("outer"), (F.col("upto") - since).alias("carry"))
    rows = rows.join(carried, [F.col(k) == F.col(f"e_{k}") for k in key]).where(F.col("header").isNull())
    place = F.col("upto") - F.col("size") - F.col("since") + F.when(F.col("own").isNull(), F.col("carry")).otherwise(0)
    return rows.select("file", "split", F.coalesce("own", "outer").alias("header"), place.alias("place"), "value").where("header is not null")


def _cells(value: str = "value", sep: str = "\t") -> Column:
    return F.split(F.col(value), sep)


def bed_sites(spark: SparkSession, path: str | list[str], chrom: str | None = None, tf: str | None = None) -> DataFrame:
    """(motif_id, tf, chrom, lo, hi, name, score, strand) of headerless BED files named <tf><chrom>.bed[.gz]: score in column 5, strand in the last one. With chrom or tf only the files that are named by it are opened."""
    c = _cells()
    names = None if chrom is None and tf is None else f"{tf or '*'}{chrom or 'chr*'}.bed{{,.gz,.bz2}}"
    rows = numbered_lines(spark, path, names)
    tf = F.regexp_extract("file", r"([^/]*?)(chr[0-9A-Za-z]+)\.bed(\.gz|\.bz2)?$", 1)
    key = F.xxhash64("file").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(1 << 32) + F.col("line")
    return rows.where(F.size(c) >= 3).select(
        key.alias("motif_id"), tf.alias("tf"), c[0].alias("chrom"), F.try_to_number(c[1], F.lit("999999999999")).cast("long").alias("lo"), F.try_to_number(c[2], F.lit("999999999999")).cast("long").alias("hi"),
        F.get(c, F.lit(3)).alias("name"), F.expr("try_cast(get(split(value, '\t'), 4) as double)").alias("score"), F.element_at(c, -1).alias("strand"),
    )


def gff_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, lo, hi): columns 1, 4 and 5."""
    return spark.read.text(path).where(~F.col("value").startswith("#")).selectExpr("split(value, '\t')[0] as chrom", "try_cast(get(split(value, '\t'), 3) as long) as lo", "try_cast(get(split(value, '\t'), 4) as long) as hi")


def variable_step(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, pos, val) of variableStep wiggle text: the chromosome after the header's last '='; values are stored as floats. Other headers end a block."""
    v = F.trim("value")
    rows = _under_headers(spark, path, F.when(v.rlike("^[A-Za-z#]"), v)).where(F.col("header").startswith("variableStep") & F.col("header").contains("chrom="))
    return rows.selectExpr("trim(element_at(split(header, '='), -1)) as chrom", r"try_cast(split(trim(value), '\\s+')[0] as long) as pos", r"try_cast(try_cast(get(split(trim(value), '\\s+'), 1) as float) as double) as val")


def fixed_step(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, block_start, pos, val) of fixedStep wiggle text. Other headers end a block."""
    v = F.trim("value")
    rows = _under_headers(spark, path, F.when(v.rlike("^[A-Za-z#]"), v)).where(F.col("header").startswith("fixedStep") & F.col("header").contains("start="))
    field = lambda k: F.regexp_extract("header", rf"{k}=(\S+)", 1)
    start = field("start").try_cast("long")
    return rows.select(field("chrom").alias("chrom"), start.alias("block_start"), (start + F.col("place") * F.coalesce(F.nullif(field("step"), F.lit("")).try_cast("long"), F.lit(1))).alias("pos"), v.try_cast("float").cast("double").alias("val"))


def bed_graph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end0, val); rows without exactly four columns or with bad numbers are left out."""
    c = r"split(value, '\t')"
    return spark.read.text(path).where(F.size(F.split("value", "\t")) == 4).selectExpr(f"{c}[0] as chrom", f"try_cast({c}[1] as long) as start0", f"try_cast({c}[2] as long) as end0", f"cast(try_cast({c}[3] as float) as double) as val").where("start0 is not null and end0 is not null and val is not null")


def bed6_values(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end0, val): the value in column 5."""
    c = r"split(value, '\t')"
    return spark.read.text(path).where(F.size(F.split("value", "\t")) >= 6).selectExpr(f"{c}[0] as chrom", f"try_cast({c}[1] as long) as start0", f"try_cast({c}[2] as long) as end0", f"cast(try_cast({c}[4] as float) as double) as val").where("start0 is not null and end0 is not null")


def _last_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("chrom", "lo", "hi").orderBy(F.desc("line")))).where("nth = 1").drop("nth", "line")


def bed6_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, lo, hi, name, strand), 1-based; of rows with one interval the last."""
    c = _cells()
    return _last_of(numbered_lines(spark, path).where(F.size(c) >= 6).select("line", c[0].alias("chrom"), (c[1].cast("long") + 1).alias("lo"), c[2].cast("long").alias("hi"), c[3].alias("name"), c[5].alias("strand")))


def bed4_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, lo, hi, name, val), 1-based: column 4 as text and as a number; of rows with one interval the last."""
    c = _cells()
    return _last_of(numbered_lines(spark, path).where(F.size(c) >= 4).select("line", c[0].alias("chrom"), (c[1].cast("long") + 1).alias("lo"), c[2].cast("long").alias("hi"), c[3].alias("name"), F.expr("try_cast(split(value, '\t')[3] as double)").alias("val")))


def ref_gene(spark: SparkSession, path: str) -> DataFrame:
    """(file_row, tx, chrom, strand, tx_start, tx_end, gene) of columns 2-6 and 13; rows whose coordinates aren't whole numbers are left out."""
    at = lambda i: f"get(split(value, '\t'), {i})"
    rows = numbered_lines(spark, path).selectExpr("line as file_row", f"{at(1)} as tx", f"{at(2)} as chrom", f"{at(3)} as strand", f"try_cast({at(4)} as long) as tx_start", f"try_cast({at(5)} as long) as tx_end", f"{at(12)} as gene")
    return rows.where("tx_start is not null and tx_end is not null and gene is not null")


def fasta_chunks(spark: SparkSession, path: str | list[str], piece: int = 4096) -> DataFrame:
    """(chrom, start, seq): parts of about `piece` bases of each sequence, from 1, without gaps; the name is the first word of the header, case is kept."""
    v = F.trim("value")
    rows = _under_headers(spark, path, F.when(v.startswith(">"), v), F.length(v))
    rows = rows.select("file", "split", F.regexp_extract("header", r"^>\s*(\S+)", 1).alias("chrom"), (F.col("place") + 1).alias("at"), v.alias("line"))
    parts = rows.groupBy("file", "split", "chrom", F.floor(F.col("at") / piece).alias("k")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))  # bounded by a piece and a line
    return parts.select("chrom", F.col("x")[0]["at"].alias("start"), F.array_join(F.transform("x", lambda x: x["line"]), "").alias("seq"))


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, seq): whole sequences, one a row; for those that a row can hold."""
    chunks = fasta_chunks(spark, path).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("x"))
    return chunks.select("chrom", F.array_join(F.transform("x", lambda x: x["seq"]), "").alias("seq"))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length), split at white space."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c")).select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("length"))


def score_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(line, columns ...) of a headerless table of numbers; 'NA' is null. `line` stands for the row order that such files share."""
    c = lambda i: f"try_cast(nullif(get(split(value, '\t'), {i}), 'NA') as double) as `{columns[i]}`"
    return numbered_lines(spark, path).selectExpr("line", *[c(i) for i in range(len(columns))])


def gold_standard(spark: SparkSession, path: str) -> DataFrame:
    """(line, gs): 1 where every column is above 0."""
    return numbered_lines(spark, path).select("line", F.forall(F.split("value", "\t"), lambda x: x.try_cast("double") > 0).cast("int").alias("gs"))


def pair_names(name: Column, cells: list[str], suffix: str) -> dict[str, Column]:
    """tf and cell type of model and target from a file name <tf><cell><tf><cell><suffix>, and whether it is on the diagonal."""
    alt = "|".join(cells)
    part = lambda i: F.regexp_extract(name, rf"^(.+?)({alt})(.+?)({alt}){suffix}$", i)
    return {"model_tf": part(1), "model_cell": part(2), "target_tf": part(3), "target_cell": part(4), "diagonal": (part(1) == part(3)) & (part(2) == part(4))}


def pair_tables(spark: SparkSession, path: str, cells: list[str], suffix: str = r"x4\.txt", header: bool = True) -> DataFrame:
    """(model, target, row, name, value) of pair files: performance files have a header; the last cell of each line is the value."""
    rows = numbered_lines(spark, path).withColumn("base", F.element_at(F.split("file", "/"), -1))
    names = pair_names(F.col("base"), cells, suffix)
    c = F.split(F.trim("value"), r"\s+")
    rows = rows.where(F.col("line") > 1) if header else rows
    return rows.select(F.concat(names["model_tf"], names["model_cell"]).alias("model"), F.concat(names["target_tf"], names["target_cell"]).alias("target"), (F.col("line") - (1 if header else 0)).cast("int").alias("row"), F.regexp_replace(F.element_at(c, 1), '"', "").alias("name"), F.element_at(c, -1).try_cast("double").alias("value")).where("model != ''")


def sam(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> DataFrame:
    """Alignments of a SAM text file (0-based pos); only references in sizes (chrom, length) if given."""
    c = _cells()
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@")).select("line", c.alias("c"))
    flag = F.col("c")[1].cast("int")
    out = rows.select(
        F.col("line").alias("file_row"), F.col("c")[0].alias("qname"), flag.alias("flag"), F.col("c")[2].alias("rname"), (F.col("c")[3].cast("int") - 1).alias("pos"), F.col("c")[4].cast("int").alias("mapq"),
        F.length(F.col("c")[9]).alias("rlen"), F.col("c")[9].alias("seq"), F.col("c")[10].alias("qual"), (F.col("c")[7].cast("int") - 1).alias("pnext"), F.col("c")[8].cast("int").alias("tlen"), (flag.bitwiseAND(1024) > 0).alias("is_dup"),
    )
    return out if sizes is None else out.join(F.broadcast(sizes), F.col("rname") == F.col("chrom"), "left_semi")
