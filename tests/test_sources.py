import gzip
import io
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.plans import files
from locusframe.sources import parts, readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


@pytest.fixture()
def here(tmp_path):
    return tmp_path


def test_bed_sites(spark, here):
    p = put(here / "CTCFchr1.bed.gz", "chr1\t10\t20\tm\t1e-5\t+\nchr1\t30\t40\tm\t2e-5\t-\n")
    got = readers.bed_sites(spark, p).orderBy("motif_id").collect()
    assert [(r.tf, r.chrom, r.lo, r.hi, r.score, r.strand) for r in got] == [("CTCF", "chr1", 10, 20, 1e-5, "+"), ("CTCF", "chr1", 30, 40, 2e-5, "-")]


def test_wiggles(spark, here):
    p = put(here / "v.wig", "track x\nvariableStep chrom=chr1\n5\t1.5\n7\t2\nvariableStep chrom=chr2\n1\t3\n")
    assert sorted(map(tuple, readers.variable_step(spark, p).collect())) == [("chr1", 5, 1.5), ("chr1", 7, 2.0), ("chr2", 1, 3.0)]
    p = put(here / "f.wig", "fixedStep chrom=chr1 start=10 step=2\n0.5\n0.25\nfixedStep chrom=chr1 start=100 step=1\n1\n")
    assert sorted(map(tuple, readers.fixed_step(spark, p).collect())) == [("chr1", 10, 10, 0.5), ("chr1", 10, 12, 0.25), ("chr1", 100, 100, 1.0)]


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_files_in_splits(spark, here, size):
    """Headers, places and line numbers go on over splits of any size."""
    r = random.Random(size)
    wig, want_v, want_f = ["track name=x"], [], []
    for c in range(12):
        if c % 2:
            wig.append(f"variableStep chrom=chr{c}")
            for p in range(1, r.randint(1, 60)):
                wig.append(f"{p * 3} {p}.5" if p % 7 else f" {p * 3}  {p}.5")
                want_v.append((f"chr{c}", p * 3, p + 0.5))
        else:
            wig.append(f"fixedStep chrom=chr{c} start={c + 1} step=2")
            for p in range(r.randint(1, 60)):
                wig += [""] if p % 11 == 5 else []
                wig.append(f"{p}.25")
                want_f.append((f"chr{c}", c + 1, c + 1 + 2 * p, p + 0.25))
    seqs = {f"s{i}": "".join(r.choice("ACGTN") for _ in range(r.randint(1, 900))) for i in range(6)}
    fa = "\n".join(f">{n} words\n" + "\n".join(s[i : i + 50] for i in range(0, len(s), 50)) for n, s in seqs.items())
    w, f = put(here / "x.wig", "\n".join(wig) + "\n"), put(here / "x.fa", fa)
    options = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        lines = readers.numbered_lines(spark, w).collect()
        assert [x.value for x in sorted(lines, key=lambda x: x.line)] == wig and {x.line for x in lines} == set(range(1, len(wig) + 1))
        assert sorted(map(tuple, readers.variable_step(spark, w).collect())) == sorted(want_v)
        assert sorted(map(tuple, readers.fixed_step(spark, w).collect())) == sorted(want_f)
        assert dict(map(tuple, readers.fasta(spark, f).collect())) == seqs
        for x in readers.fasta_chunks(spark, f, 100).collect():
            assert seqs[x.chrom][x.start - 1 :].startswith(x.seq) and len(x.seq) <= 200
    finally:
        for k in options:
            spark.conf.unset(k)


def test_interval_files(spark, here):
    p = put(here / "a.bg", "chr1\t0\t5\t0.5\nbad\trow\nchr1\tx\t9\t1\nchr2\t3\t4\t2\n")
    assert sorted(map(tuple, readers.bed_graph(spark, p).collect())) == [("chr1", 0, 5, 0.5), ("chr2", 3, 4, 2.0)]
    p = put(here / "b.bed", "chr1\t0\t5\tn1\t3\t+\nchr1\t0\t5\tn2\t4\t-\n")
    assert [tuple(r) for r in readers.bed6_annotations(spark, p).collect()] == [("chr1", 1, 5, "n2", "-")]
    assert sorted(r.val for r in readers.bed6_values(spark, p).collect()) == [3.0, 4.0]
    p = put(here / "c.bed", "chr1\t0\t5\t7\nchr1\t0\t5\tq\n")
    assert [tuple(r) for r in readers.bed4_annotations(spark, p).collect()] == [("chr1", 1, 5, "q", None)]
    p = put(here / "d.gff", "#c\nchr1\ts\tgene\t3\t9\t.\n")
    assert [tuple(r) for r in readers.gff_ranges(spark, p).collect()] == [("chr1", 3, 9)]


def test_genes_sequences_sizes(spark, here):
    row = lambda tx, a, b, g: "\t".join(["0", tx, "chr1", "+", a, b, *"x" * 6, g])
    p = put(here / "r.txt", row("t1", "5", "10", "g1") + "\n" + row("t2", "start", "10", "g2") + "\n" + row("t3", "1", "2", "g3") + "\n")
    assert [(r.file_row, r.tx, r.tx_start, r.gene) for r in readers.ref_gene(spark, p).orderBy("file_row").collect()] == [(1, "t1", 5, "g1"), (3, "t3", 1, "g3")]
    p = put(here / "g.fa", ">chr1 hg\nACgt\nNN\n>chr2\nA\n")
    assert sorted(map(tuple, readers.fasta(spark, p).collect())) == [("chr1", "ACgtNN"), ("chr2", "A")]
    p = put(here / "s.size", "chr1\t100\nchr2   50\n")
    assert sorted(map(tuple, readers.chrom_sizes(spark, p).collect())) == [("chr1", 100), ("chr2", 50)]


def test_tables_of_scores_and_pairs(spark, here):
    p = put(here / "x.txt.gz", "1\tNA\n2\t3.5\n")
    assert [tuple(r) for r in readers.score_table(spark, p, ["a", "b"]).orderBy("line").collect()] == [(1, 1.0, None), (2, 2.0, 3.5)]
    p = put(here / "gs.txt", "1\t2\n0\t5\n")
    assert [r.gs for r in readers.gold_standard(spark, p).orderBy("line").collect()] == [1, 0]
    p = put(here / "CTCFK562JUNHepg2x4.txt", '"V1"\n"1" 0.5\n"2" 0.25\n')
    got = readers.pair_tables(spark, p, ["K562", "Hepg2", "A549"]).orderBy("row").collect()
    assert [(r.model, r.target, r.row, r.value) for r in got] == [("CTCFK562", "JUNHepg2", 1, 0.5), ("CTCFK562", "JUNHepg2", 2, 0.25)]


def bam_bytes():
    def record(name, ref, pos, mapq, flag, seq, qual, pnext, tlen):
        codes = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, 1, flag, len(seq), 0, pnext, tlen) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(qual)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chrM"))
    out = io.BytesIO()
    for part in (head, record("r1", 0, 9, 40, 99, "ACGTN", [30] * 5, 50, 60) + record("r2", 1, 3, 10, 1107, "AC", [2, 3], 0, -5)):
        out.write(gzip.compress(part))
    return out.getvalue()


def test_alignments(spark, here):
    (here / "x.bam").write_bytes(bam_bytes())
    got = readers.bam(spark, str(here / "x.bam")).orderBy("file_row").collect()
    assert [tuple(r) for r in got] == [(1, "r1", 99, "chr1", 9, 40, 5, "ACGTN", "?????", 50, 60, False), (2, "r2", 1107, "chrM", 3, 10, 2, "AC", "#$", 0, -5, True)]
    spark.dataSource.register(readers.BamSource)
    assert spark.read.format("bam").load(str(here / "x.bam")).count() == 2
    sizes = spark.createDataFrame([("chr1", 1000)], "chrom string, length long")
    assert readers.bam(spark, str(here / "x.bam"), sizes).count() == 1
    p = put(here / "x.sam", "@HD\nr1\t99\tchr1\t10\t40\t5M\t=\t51\t60\tACGTN\t?????\n")
    r = readers.sam(spark, p).first()
    assert (r.qname, r.pos, r.pnext, r.rlen, r.is_dup) == ("r1", 9, 50, 5, False)


def test_sinks(spark, here):
    track = spark.createDataFrame([("chr2", 5, 0.1), ("chr1", 7, 2.0)], "chrom string, pos long, val double")
    writers.track_cache(track, str(here / "t"))
    back = {r.chrom: r.val for r in writers.read_track(spark, str(here / "t")).collect()}
    assert back["chr1"] == 2.0 and abs(back["chr2"] - 0.1) < 1e-7 and back["chr2"] != 0.1
    writers.score_table(spark.createDataFrame([(2, 0.5), (1, None)], "motif_id long, s double"), str(here / "s"))
    assert sorted(r.value for r in spark.read.text(str(here / "s")).collect()) == ["1\tNA", "2\t0.5"]
    writers.pair_matrix(spark.createDataFrame([("a", "b", 1.0)], "model string, target string, value double"), str(here / "p"))
    writers.cut_sites(spark.createDataFrame([("c", 5)], "rname string, cut long"), str(here / "c"))
    writers.predictions(spark.createDataFrame([("c", 1, 2, 0.5)], "chrom string, lo long, hi long, score double"), str(here / "z"))
    assert spark.read.parquet(str(here / "c")).count() == 1 and spark.read.text(str(here / "z")).first().value == "c\t1\t2\t0.5"


def test_only_the_files_of_a_chromosome_are_opened(spark, here):
    for tf in ("CTCF", "JUN"):
        for chrom in ("chr1", "chr11", "chrX"):
            put(here / f"sites/{tf}{chrom}.bed", f"{chrom}\t5\t9\tm\t0.5\t+\n")
    sites = str(here / "sites")
    one = readers.bed_sites(spark, sites, "chr1")
    assert sorted((r.tf, r.chrom) for r in one.collect()) == [("CTCF", "chr1"), ("JUN", "chr1")] and len(one.inputFiles()) == 2
    assert len(readers.bed_sites(spark, sites, tf="JUN").inputFiles()) == 3
    assert [(r.tf, r.chrom) for r in readers.bed_sites(spark, sites, "chrX", "CTCF").collect()] == [("CTCF", "chrX")]
    assert readers.bed_sites(spark, sites).count() == 6


def test_named_texts(spark, here):
    rows = [("a.txt", 2, "second"), ("a.txt", 1, "first"), ("k/b.txt.gz", 1, "x\ty"), (None, 1, "no"), ("c.txt", 1, None), ("k/b.txt.gz", 2, "")]
    parts.named_texts(spark.createDataFrame(rows, "name string, at long, value string"), str(here / "n"))
    assert (here / "n/a.txt").read_text() == "first\nsecond\n" and gzip.open(here / "n/k/b.txt.gz", "rt").read() == "x\ty\n\n"
    assert sorted(p.name for p in (here / "n").rglob("*") if p.is_file() and p.name[0] != "_") == ["a.txt", "b.txt.gz"]
    assert not list((here / "n").glob("_trial*"))
    parts.named_texts(spark.createDataFrame([], "name string, at long, value string"), str(here / "none"))
    assert [p.name for p in (here / "none").iterdir()] == ["_SUCCESS"]


def test_blocks_keep_their_headers_in_any_number_of_tasks(spark):
    """Headers stand above their lines also where small shuffles are put together and large ones aren't; a key's lines are in one file."""
    sets = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4kb", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8kb"}
    before = {k: spark.conf.get(k) for k in sets}
    for k, v in sets.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(6000).selectExpr("concat('chr', id % 5) as chrom", "id div 5 as at", "repeat('ACGT', 20) as seq").withColumn("at", F.sum(F.lit(1)).over(W.partitionBy("chrom").orderBy("at")))
        path = files._blocks(rows, "concat('>', chrom)", "seq", ["chrom"], "at", "blocks")
        assert {(r.chrom, len(r.seq)) for r in readers.fasta(spark, path).collect()} == {(f"chr{i}", 96_000) for i in range(5)}
        path = files._blocks(rows.selectExpr("*", "at div 100 as piece"), "concat('fixedStep chrom=', chrom, ' start=', piece, ' step=1')", "cast(at as string)", ["chrom", "piece"], "at", "fixed")
        assert {r.n for r in readers.fixed_step(spark, path).groupBy("chrom", "block_start").agg(F.count("*").alias("n")).collect()} <= {99, 100, 1}
        assert len({r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_of_one_split_are_many_tasks(spark, here, monkeypatch):
    """Headers and places go on from piece to piece, and no task gets all lines of a split."""
    wig, want = ["track name=x"], []
    for start, n in ((1, 40_000), (100_000, 3), (200_000, 0), (300_000, 33_333), (400_000, 1), (500_000, 20_000)):
        wig.append(f"fixedStep chrom=chr1 start={start} step=3")
        wig += [str(i % 64) for i in range(n)]
        want += [("chr1", start, start + 3 * i, float(i % 64)) for i in range(n)]
    path = put(here / "long.wig", "\n".join(wig) + "\n")
    rows = readers.fixed_step(spark, path).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in rows) == want
    assert max(Counter(r.task for r in rows).values()) < len(want)
    monkeypatch.setattr(readers, "PIECE_LINES", 7)
    monkeypatch.setattr(readers, "TASK_BYTES", 20_000)
    rows = readers.fixed_step(spark, path).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in rows) == want
    assert max(Counter(r.task for r in rows).values()) < len(want) / 5
    fa = put(here / "long.fa", ">a x\nACGT\nAC\n>b\n>c\n" + "GATTACA\n" * 50 + ">d\nT\n")
    assert dict(map(tuple, readers.fasta(spark, fa).collect())) == {"a": "ACGTAC", "c": "GATTACA" * 50, "d": "T"}
