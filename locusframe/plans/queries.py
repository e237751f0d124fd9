"""One query for each operator over the test projections, and its SQL in another formulation where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import accessibility as acc
from locusframe.operators import curves, footprint, intervals, mapping, matrix, reads, sequence, similarity, training
from locusframe.operators import pairs as pairs_of
from locusframe.scratch import materialise
from locusframe.testbed import MIXTURE as M
from locusframe.testbed import SMALL_MIXTURE
from locusframe.testbed import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sites(spark: SparkSession, d: str, margin: int = 0) -> DataFrame:
    return view(spark, d, "motifs").select(F.col("motif_id").alias("id"), "chrom", (F.col("st") - margin).alias("lo"), (F.col("en") + margin).alias("hi"), "strand")


_CUTS = "cuts as (select motif_id, m.chrom, st - 100 as win_lo, en + 100 as win_hi, coalesce(sum(val), 0) as cut_count from motifs m left join signal s on s.chrom = m.chrom and s.pos between st - 100 and en + 100 group by 1, 2, 3, 4)"


@query(with_views("select motif_id, chrom, win_lo, win_hi, cast(cut_count as double) as cut_count from cuts", "motifs", "signal", more=_CUTS))
def site_cut_counts(spark: SparkSession, d: str) -> DataFrame:
    w = _sites(spark, d, 100)
    total = intervals.range_sum(w, view(spark, d, "signal"))
    return w.join(total, "id").select(F.col("id").alias("motif_id"), "chrom", F.col("lo").alias("win_lo"), F.col("hi").alias("win_hi"), F.col("total").alias("cut_count"))


_FLANKS = """flanks as (select motif_id, cast(coalesce(sum(val) filter (pos between st and en), 0) as double) as cent,
  cast(coalesce(sum(val) filter (pos not between st and en), 0) as double) as flank_count
  from motifs m left join signal s on s.chrom = m.chrom and s.pos between st - 100 and en + 100 group by 1)"""


@query(with_views("select * from flanks", "motifs", "signal", more=_FLANKS))
def site_flank_counts(spark: SparkSession, d: str) -> DataFrame:
    return footprint.flank_counts(_sites(spark, d), view(spark, d, "signal")).select(F.col("id").alias("motif_id"), "cent", F.col("count").alias("flank_count"))


@query(with_views("""select motif_id, cast(coalesce(sum(val * (case when pos between fl and en - 1 then 1 else 0 end + case when pos between fl + 1 and en then 1 else 0 end)), 0) as double) as left_total,
  cast(coalesce(sum(val * (case when pos between st and fr - 1 then 1 else 0 end + case when pos between st + 1 and fr then 1 else 0 end)), 0) as double) as right_total
  from w left join signal s on s.chrom = w.chrom and s.pos between fl and fr group by 1""", "motifs", "signal",
  more="w as (select *, greatest(0, st - cast(floor(1.75 * (en - st + 1) + 0.5) as bigint)) as fl, en + cast(floor(1.75 * (en - st + 1) + 0.5) as bigint) as fr from motifs)"))
def footprint_inputs(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "signal")
    return footprint.side_totals(_sites(spark, d), s, s).withColumnRenamed("id", "motif_id")


@query(with_views("select chrom, min(pos) as run_start, max(pos) as run_end, cast(val as double) as val from (select *, pos - row_number() over (partition by chrom, val order by pos) as k from signal) group by chrom, val, k", "signal"))
def signal_runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.signal_runs(view(spark, d, "signal")).withColumn("val", F.col("val").cast("double"))


_MAP = """span as (select chrom, min(start0) + 1 as first, max(end0) + 1 as last from maptrack group by 1),
cl as (select motif_id, m.chrom, greatest(st - 100, first) as lo, least(en + 100, last) as hi from motifs m left join span using (chrom)),
mp as (select motif_id, coalesce(sum(val * (least(hi, end0) - greatest(lo, start0 + 1) + 1)) / (max(hi) - max(lo) + 1), 0) as map_mean
  from cl left join maptrack t on t.chrom = cl.chrom and start0 + 1 <= hi and end0 >= lo group by 1)"""


@query(with_views("select motif_id, round(map_mean, 6) as map_mean from mp", "motifs", "maptrack", more=_MAP))
def mappability_mean(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_mean(_sites(spark, d, 100), view(spark, d, "maptrack")).select(F.col("id").alias("motif_id"), F.round("mean", 6).alias("map_mean"))


@query(with_views("select motif_id, round(map_mean, 6) as average, (select greatest(max(hi) - max(lo) + 1, 0) from cl where cl.motif_id = mp.motif_id) as size from mp", "motifs", "maptrack", more=_MAP))
def mappability_range(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_query(_sites(spark, d, 100), view(spark, d, "maptrack")).select(F.col("id").alias("motif_id"), F.round("average", 6).alias("average"), "size")


_CONS = """cons as (select motif_id, case when count(b.pos) > 0 then sum(b.val) / (max(en) - max(st) + 1) when min(f.first) < max(st) then null else 0 end as cons
  from motifs m left join blocks b on b.chrom = m.chrom and b.pos between st and en left join (select chrom, min(pos) as first from blocks group by 1) f on f.chrom = m.chrom group by 1)"""


@query(with_views("select motif_id, round(cons, 10) as cons from cons", "motifs", "blocks", more=_CONS))
def conservation_mean(spark: SparkSession, d: str) -> DataFrame:
    return intervals.block_mean(_sites(spark, d), view(spark, d, "blocks")).select(F.col("id").alias("motif_id"), F.round("mean", 10).alias("cons"))


#: The conservation tracks, in the order of their columns.
TRACKS = ("pc100v", "pc46v", "pc46m", "pc46p", "pp100v", "pp46v", "pp46m", "pp46p")
_TRACK = lambda k: f"case when (pos + {k}) % 5 < 2 then null else val * {k + 1} end"


@query(with_views("select motif_id, " + ", ".join(f"round(case when count(t.{n}) > 0 then sum(t.{n}) / (max(en) - max(st) + 1) when min(f.{n}) < max(st) then null else 0 end, 9) as {n}" for n in TRACKS)
  + " from motifs m left join t on t.chrom = m.chrom and t.pos between st and en left join f on f.chrom = m.chrom group by 1", "motifs", "blocks",
  more="t as (select chrom, pos, " + ", ".join(f"{_TRACK(k)} as {n}" for k, n in enumerate(TRACKS)) + " from blocks), f as (select chrom, " + ", ".join(f"min(case when {n} is not null then pos end) as {n}" for n in TRACKS) + " from t group by 1)"))
def conservation_tracks(spark: SparkSession, d: str) -> DataFrame:
    blocks = view(spark, d, "blocks").selectExpr("chrom", "pos", *[f"{_TRACK(k)} as {n}" for k, n in enumerate(TRACKS)])
    out = intervals.block_means(_sites(spark, d), blocks, TRACKS)
    return out.select(F.col("id").alias("motif_id"), *[F.round(n, 9).alias(n) for n in TRACKS])


_RANGE = """select motif_id, round(coalesce(sum(val), 0) / (max(b) - max(a) + 1), 8) as average, max(b) - max(a) + 1 as size, cast(coalesce(sum(val), 0) as double) as total
  from w left join signal s on s.chrom = w.chrom and s.pos between a and b group by 1"""


@query(with_views(_RANGE, "motifs", "signal", more="w as (select motif_id, chrom, st - 100 as a, en + 100 as b from motifs)"))
def signal_range(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.range_query(_sites(spark, d, 100), view(spark, d, "signal"))
    return out.select(F.col("id").alias("motif_id"), F.round("average", 8).alias("average"), "size", "total")


@query(with_views(_RANGE, "motifs", "signal", more="""e as (select chrom, min(pos) as lo, max(pos) + 1 as hi from signal group by 1),
w as (select motif_id, m.chrom, greatest(lo, least(st - 30100, hi)) as a, greatest(lo, least(en + 100, hi)) as b from motifs m join e using (chrom))"""))
def signal_range_clamped(spark: SparkSession, d: str) -> DataFrame:
    sites = _sites(spark, d, 100).withColumn("lo", F.col("lo") - 30_000)
    out = intervals.range_query(sites, view(spark, d, "signal"), clamp=True)
    return out.select(F.col("id").alias("motif_id"), F.round("average", 8).alias("average"), "size", "total")


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "exclusion").select(F.col("chrom").alias("r_chrom"), (F.col("start0") + 1).alias("r_lo"), (F.col("end0") - 1).alias("r_hi"), "name", F.col("strand").alias("r_strand"))


@query(with_views("select motif_id, chrom from motifs m where not exists (select 1 from exclusion e where e.chrom = m.chrom and start0 + 1 <= en and end0 > st)", "motifs", "exclusion"))
def excluded_sites(spark: SparkSession, d: str) -> DataFrame:
    return intervals.without_overlap(_sites(spark, d), _excluded(spark, d)).select(F.col("id").alias("motif_id"), "chrom")


@query(with_views("select motif_id, chrom from motifs m where not exists (select 1 from exclusion e where e.chrom = m.chrom and e.strand = m.strand and start0 + 1 <= en and end0 > st)", "motifs", "exclusion"))
def same_strand_excluded(spark: SparkSession, d: str) -> DataFrame:
    return intervals.without_overlap(_sites(spark, d), _excluded(spark, d), F.col("strand") == F.col("r_strand")).select(F.col("id").alias("motif_id"), "chrom")


@query(with_views("select motif_id, string_agg(distinct name, ',' order by name) as names from motifs m join exclusion e on e.chrom = m.chrom and start0 + 1 <= en and end0 > st group by 1", "motifs", "exclusion"))
def overlap_names(spark: SparkSession, d: str) -> DataFrame:
    excluded = _excluded(spark, d)
    names = lambda places: intervals.overlaps(places, excluded).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return intervals.per_place(_sites(spark, d), ["chrom", "lo", "hi"], names).withColumnRenamed("id", "motif_id")


_TSS = """kept as (select t.*, case when strand = '+' then tx_start else tx_end end as ts, case when strand = '+' then tx_end else tx_start end as te from transcripts t
  where not exists (select 1 from transcripts e where e.gene = t.gene and e.file_row < t.file_row and e.tx_end - e.tx_start >= t.tx_end - t.tx_start)),
tss as (select * from kept qualify row_number() over (partition by chrom, ts order by file_row desc) = 1)"""


@query(with_views("select file_row, tx, chrom, gene, ts, te from tss", "transcripts", more=_TSS))
def tss_record_setters(spark: SparkSession, d: str) -> DataFrame:
    return intervals.transcript_starts(view(spark, d, "transcripts")).select("file_row", "tx", "chrom", "gene", "ts", "te")


_NEAR = """near as (select motif_id, concat(gene, '__', tx) as gene_tx, abs(ts - mid) as distance from (select motif_id, chrom, st + (en - st) // 2 as mid from motifs) m
  left join tss using (chrom) qualify row_number() over (partition by motif_id order by abs(ts - mid), ts desc) = 1)"""


def _nearest(spark: SparkSession, d: str, sites: DataFrame | None = None) -> DataFrame:
    tss = intervals.transcript_starts(view(spark, d, "transcripts")).select("chrom", "ts", F.concat_ws("__", "gene", "tx").alias("info"))
    mids = (_sites(spark, d) if sites is None else sites).select("id", "chrom", F.expr("lo + (hi - lo) div 2").alias("mid"))
    return intervals.nearest(mids, tss)


@query(with_views("select * from near", "motifs", "transcripts", more=f"{_TSS}, {_NEAR}"))
def nearest_gene(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(F.col("id").alias("motif_id"), F.col("info").alias("gene_tx"), "distance")


@query(with_views("select motif_id, distance from near", "motifs", "transcripts", more=f"{_TSS}, {_NEAR.replace('ts - mid', 'te - mid').replace('ts desc', 'te desc')}"))
def distance_to_transcript_end(spark: SparkSession, d: str) -> DataFrame:
    ends = intervals.transcript_starts(view(spark, d, "transcripts")).groupBy("chrom", F.col("te").alias("ts")).agg(F.max("tx").alias("info"))
    mids = _sites(spark, d).select("id", "chrom", F.expr("lo + (hi - lo) div 2").alias("mid"))
    return intervals.nearest(mids, ends).select(F.col("id").alias("motif_id"), "distance")


@query(with_views("select motif_id, count(distinct gene) as n_genes, string_agg(distinct gene, ',' order by gene) as genes from motifs m join tss t on t.chrom = m.chrom and tx_start - 1 - 500 <= en and tx_end + 500 > st group by 1", "motifs", "transcripts", more=_TSS))
def genes_in_window(spark: SparkSession, d: str) -> DataFrame:
    t = intervals.transcript_starts(view(spark, d, "transcripts")).select(F.col("chrom").alias("r_chrom"), (F.col("tx_start") - 501).alias("r_lo"), (F.col("tx_end") + 499).alias("r_hi"), "gene")
    found = intervals.overlaps(_sites(spark, d), t, 4096).groupBy(F.col("id").alias("motif_id")).agg(F.array_sort(F.collect_set("gene")).alias("g"))
    return found.select("motif_id", F.size("g").cast("long").alias("n_genes"), F.array_join("g", ",").alias("genes"))


_PAIRED = """pc as (select file_row, rname, flag, pos + case when flag in (83, 147) then rlen - 5 else 4 end as cut, case when flag in (83, 147) then '-' else '+' end as strand
  from reads where mapq >= 30 and is_dup = 0 and flag in (83, 147, 163, 99) qualify row_number() over (partition by rname, pos, flag order by file_row) <= 50)"""


@query(with_views("select * from pc", "reads", more=_PAIRED))
def cuts_paired(spark: SparkSession, d: str) -> DataFrame:
    return reads.paired_cuts(view(spark, d, "reads"))


@query(with_views("""select file_row, rname, flag, pos + case when flag = 83 then rlen - 1 else 0 end as cut, case when flag = 83 then '-' else '+' end as strand
  from (select *, (select count(*) from reads e where e.rname = r.rname and e.pos = r.pos and e.flag = r.flag and e.file_row <= r.file_row and e.mapq >= 25 and e.is_dup = 0) as k
        from reads r where mapq >= 25 and is_dup = 0 and flag in (83, 99)) where k <= 50""", "reads"))
def cuts_single(spark: SparkSession, d: str) -> DataFrame:
    return reads.single_cuts(view(spark, d, "reads"), minus_flag=83, plus_flag=99)


@query(with_views("select rname, pos + case when flag in (83, 147) then 31 else 4 end as cut, count(*) as n from reads where mapq >= 30 and flag in (83, 147, 163, 99) group by 1, 2", "reads"))
def duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.duplicate_counts(view(spark, d, "reads"))


@query(with_views("select rname, pos + case when flag = 83 then 31 else 4 end as cut, count(*) as n from reads where mapq >= 20 and is_dup = 0 and flag in (83, 99) group by 1, 2", "reads"))
def single_duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.single_duplicate_counts(view(spark, d, "reads"), minus_flag=83, plus_flag=99)


@query(with_views("select file_row, rname, flag, pos + case when flag in (83, 147) then -5 else 4 end as pos from reads where mapq > 30 and flag in (83, 147, 163, 99)", "reads"))
def shifted_reads(spark: SparkSession, d: str) -> DataFrame:
    return reads.shifted(view(spark, d, "reads"))


@query(with_views("select rname as chrom, cut + 1 as pos, count(*) as val from pc group by 1, 2", "reads", more=_PAIRED))
def pileup(spark: SparkSession, d: str) -> DataFrame:
    return reads.pileup(reads.paired_cuts(view(spark, d, "reads")))


def _composition_sql(key: str) -> str:
    """The columns of each window from w (key, p0, p100, ...)."""
    cols = []
    for w in sequence.WINDOWS:
        n = f"p{w}"
        cg = f"cast(length(regexp_replace({n}, '[^CcGg]', '', 'g')) as double)"
        cpg = f"cast((length({n}) - length(regexp_replace({n}, 'CG|Cg|cG', '', 'g'))) / 2 as double)"
        cols += [f"{cpg} as cpg_{w}", f"case when {cg} = 0 then -1 else {cpg} * length({n}) / (({cg} / 2) * ({cg} / 2)) end as ratio_{w}", f"{cg} / nullif(length({n}), 0) as gc_{w}",
                 f"case when {n} = '' then 5 when regexp_full_match({n}, '[acgt]+') then 3 when regexp_full_match({n}, '[ACGT]+') then 1 else 2 end as class_{w}"]
    return f"select {key}, {', '.join(cols)} from w"


def _windows_sql(lo: str, hi: str) -> str:
    return ", ".join(f"substr(seq, greatest({lo} - {w}, 1), greatest(least({hi} + {w}, length(seq)) - greatest({lo} - {w}, 1) + 1, 0)) as p{w}" for w in sequence.WINDOWS)


@query(f"""with s as (select doc_id, regexp_replace(translate(text, 'eaoinrtslu', 'ACGTacgtCG'), '[^ACGTacgt]', '', 'g') as seq from documents),
t as (select *, length(seq) // 3 + 1 as lo, least(length(seq), length(seq) // 3 + 20) as hi from s), w as (select doc_id, {_windows_sql('lo', 'hi')} from t) {_composition_sql('doc_id')}""")
def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    seq = F.regexp_replace(F.translate("text", "eaoinrtslu", "ACGTacgtCG"), "[^ACGTacgt]", "")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), seq.alias("seq"))
    sites = docs.selectExpr("id", "seq", "cast(length(seq) div 3 + 1 as int) as lo", "cast(least(length(seq), length(seq) div 3 + 20) as int) as hi")
    return sequence.sequence_features(sites).withColumnRenamed("id", "doc_id")


_SEQ = f"""chr as (select chrom, string_agg(seq, '' order by start) as seq from genome group by 1),
w as (select motif_id, {_windows_sql('st', 'en')} from (select motif_id, st, en, coalesce(seq, '') as seq from motifs left join chr using (chrom))),
sq as ({_composition_sql('motif_id')})"""


def _site_sequence(spark: SparkSession, d: str, sites: DataFrame) -> DataFrame:
    return sequence.sequence_features(sequence.with_sequence(sites, view(spark, d, "genome")))


@query(with_views("select * from sq", "motifs", "genome", more=_SEQ))
def site_sequence_features(spark: SparkSession, d: str) -> DataFrame:
    return intervals.per_place(_sites(spark, d), ["chrom", "lo", "hi"], lambda places: _site_sequence(spark, d, places)).withColumnRenamed("id", "motif_id")


def _log_pmf(c: str, mu: float, theta: float) -> str:
    return f"(lgamma({c} + {theta!r}) - lgamma({theta!r}) - lgamma({c} + 1) + {theta * math.log(theta / (theta + mu))!r} + {c} * {math.log(mu / (mu + theta))!r})"


_GRID = f"""grid as (select c as count, {math.log((1 - M.prob1) / M.prob1)!r} + {_log_pmf('c', M.mu2, M.theta2)} - {_log_pmf('c', M.mu1, M.theta1)} as score
  from (select unnest(range(cast((select max(cut_count) from cuts) as bigint) + 1)) as c)),
cut as (select min(g.count) as cutoff from grid g join grid b on b.count = g.count - 1 where g.count >= 1 and g.score > ln(2) and g.score > b.score)"""


@query(with_views("select count, round(score, 6) as score from grid", "motifs", "signal", more=f"{_CUTS}, {_GRID}"))
def nb_score_grid(spark: SparkSession, d: str) -> DataFrame:
    top = site_cut_counts(spark, d).agg(F.max("cut_count").alias("top"))
    return acc.score_grid(top, M).select("count", F.round("score", 6).alias("score"))


_CALLS = f"{_CUTS}, {_GRID}, calls as (select motif_id, cut_count, score, case when cutoff is null then null when cut_count >= cutoff then 1 else 0 end as accessible from cuts join grid on grid.count = cast(cut_count as bigint) cross join cut)"


@query(with_views("select motif_id, cast(cut_count as double) as cut_count, round(score, 6) as score, accessible from calls", "motifs", "signal", more=_CALLS))
def site_calls(spark: SparkSession, d: str) -> DataFrame:
    return acc.call_sites(site_cut_counts(spark, d), M).withColumn("score", F.round("score", 6))


def small_site_calls(spark: SparkSession, d: str) -> DataFrame:
    """site_calls with parameters that fit the smallest tables."""
    return acc.call_sites(site_cut_counts(spark, d), SMALL_MIXTURE)


@query(with_views("select cast(cut_count as bigint) as count, count(*) as n from cuts group by 1", "motifs", "signal", more=_CUTS))
def count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return acc.histogram(site_cut_counts(spark, d), "cut_count")


@query(with_views(f"""select round(sum(case when c = 0 then {M.prob0!r} / s else 0 end), 4) as zero, round(sum(a / s), 4) as one, round(sum(b / s), 4) as two from
  (select *, (case when c = 0 then {M.prob0!r} else 0 end) + a + b as s from (select cut_count as c, exp({_log_pmf('cut_count', M.mu1, M.theta1)}) * {(1 - M.prob0) * M.prob1!r} as a, exp({_log_pmf('cut_count', M.mu2, M.theta2)}) * {(1 - M.prob0) * (1 - M.prob1)!r} as b from cuts))""", "motifs", "signal", more=_CUTS))
def posterior_sums(spark: SparkSession, d: str) -> DataFrame:
    return acc.posterior_sums(count_histogram(spark, d), M).select(*[F.round(c, 4).alias(c) for c in ("zero", "one", "two")])


_FEATURES = ["motif_score", "map", "cons", "dtss", "acces", "repeats", "gc_w1", "cpg_w1"]
_MATRIX = f"""{_CALLS}, {_FLANKS}, {_MAP}, {_CONS}, {_TSS}, {_NEAR}, {_SEQ},
raw as (select motif_id, m.score, distance as dtss, accessible as acces, case when cent * 10 < flank_count then 1 else 0 end as footprint, map_mean as map, cons,
  class_0 as repeats, gc_100 as gc_w1, cpg_100 as cpg_w1, ratio_400 as cpg_wr4, gc_400 as gc_w4
  from motifs m join calls using (motif_id) join flanks using (motif_id) join mp using (motif_id) join cons using (motif_id) join near using (motif_id) join sq using (motif_id)),
fm as (select motif_id, dtss, map, cons, repeats, gc_w1, cpg_w1, (-ln(score) - (select avg(-ln(score)) from raw)) / (select avg(-ln(score)) from raw) as motif_score,
  case when (select count(distinct dtss < 1000) from raw) < 2 then 1 when dtss < 1000 then 2 else 1 end as tss, acces + 1 as acces, footprint + 1 as footprint,
  case when cpg_wr4 > 0.6 and gc_w4 > 0.5 then 2 else 1 end as cpg_island from raw)"""
_ALL = ("motifs", "signal", "maptrack", "blocks", "transcripts", "genome")


def _matrix(spark: SparkSession, d: str, m=M) -> DataFrame:
    by = lambda x, *c: x.select(F.col("id").alias("motif_id"), *c)

    def features(places: DataFrame) -> DataFrame:
        """All but a site's own score: what its place says."""
        # The flanks are the window of the cut counts without the site, so one pass over the signal gives both.
        cuts = by(intervals.range_sums(places, {"cent": ("lo", "hi"), "cut_count": (F.col("lo") - 100, F.col("hi") + 100)}, view(spark, d, "signal"), shared=False), "cent", "cut_count")
        wide = places.select("id", "chrom", (F.col("lo") - 100).alias("lo"), (F.col("hi") + 100).alias("hi"))
        return matrix.assemble([
            by(_nearest(spark, d, places), F.col("distance").alias("dtss")),
            acc.call_sites(cuts, m, keep=("cent",)).select("motif_id", F.col("accessible").alias("acces"), (F.col("cent") * 10 < F.col("cut_count") - F.col("cent")).cast("int").alias("footprint")),
            by(intervals.interval_mean(wide, view(spark, d, "maptrack"), shared=False), F.col("mean").alias("map")),
            by(intervals.block_mean(places, view(spark, d, "blocks"), shared=False), F.col("mean").alias("cons")),
            by(_site_sequence(spark, d, places), *[F.col(a).alias(b) for a, b in (("class_0", "repeats"), ("gc_100", "gc_w1"), ("cpg_100", "cpg_w1"), ("ratio_400", "cpg_wr4"), ("gc_400", "gc_w4"))]),
        ]).withColumnRenamed("motif_id", "id")

    sites = view(spark, d, "motifs").select("motif_id", "score")
    # Written once: means and rows, and whatever standardises the result, read it again.
    return matrix.derive(materialise(matrix.assemble([sites, by(intervals.per_place(_sites(spark, d), ["chrom", "lo", "hi"], features), "dtss", "acces", "footprint", "map", "cons", "repeats", "gc_w1", "cpg_w1", "cpg_wr4", "gc_w4")]), "features"))


@query(with_views("select motif_id, dtss, round(map, 6) as map, round(cons, 10) as cons, repeats, round(gc_w1, 6) as gc_w1, cpg_w1, round(motif_score, 6) as motif_score, tss, acces, footprint, cpg_island from fm", *_ALL, more=_MATRIX))
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("motif_id", "dtss", F.round("map", 6).alias("map"), F.round("cons", 10).alias("cons"), "repeats", F.round("gc_w1", 6).alias("gc_w1"), "cpg_w1", F.round("motif_score", 6).alias("motif_score"), "tss", "acces", "footprint", "cpg_island")


@query()
def feature_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature table as models get it: mappable sites, complete rows, a seeded sample of 500."""
    rows = _matrix(spark, d, SMALL_MIXTURE)
    return matrix.finish(rows, _mappable_sites(spark, d), 500)


@query()
def sampled_cut_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cut counts of a quarter of the mappable sites."""
    return matrix.cut_counts(site_cut_counts(spark, d), _mappable_sites(spark, d), 4)


def _mappable_sites(spark: SparkSession, d: str) -> DataFrame:
    # The fixture's mappability ends at 0.78, that of genomes at 1.
    m = intervals.interval_mean(_sites(spark, d, 100), view(spark, d, "maptrack")).select(F.col("id").alias("motif_id"), F.least(F.col("mean") * 1.28, F.lit(1.0)).alias("mean"))
    return acc.mappable(m, "mean", 0.05)


# Products of the motif score, whose mean is a sum in any order, are rounded; the others are the same numbers everywhere.
_PRODUCTS = ", ".join((f"round(cast({a} * {b} as double), 8)" if "motif_score" in (a, b) else f"cast({a} * {b} as double)") + f' + 0e0 as "{a} x {b}"' for i, a in enumerate(_FEATURES) for b in _FEATURES[i:])


@query(with_views(f"select motif_id, {_PRODUCTS} from fm where cons is not null and acces is not null and dtss is not null and gc_w1 is not null", *_ALL, more=_MATRIX))
def interactions(spark: SparkSession, d: str) -> DataFrame:
    out = matrix.interactions(_matrix(spark, d).na.drop("any"), _FEATURES, ["motif_id"])
    value = lambda c: F.round(F.col(f"`{c}`").cast("double"), 8) if "motif_score" in c else F.col(f"`{c}`").cast("double")
    return out.select("motif_id", *[(value(c) + F.lit(0.0)).alias(c) for c in out.columns if " x " in c])


_Z = "z as (select motif_id, " + ", ".join(f"(cast({c} as double) - avg({c}) over ()) / nullif(sqrt(var_samp({c}) over ()), 0) as {c}" for c in _FEATURES) + " from fm where cons is not null and acces is not null and dtss is not null and gc_w1 is not null)"
_WEIGHTS = {"motif_score": 0.4, "map": 0.2, "cons": 0.7, "dtss": -0.3, "acces": 1.1, "repeats": -0.1, "gc_w1": 0.25, "cpg_w1": 0.15}


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return matrix.standardise(_matrix(spark, d).na.drop("any"), _FEATURES, ["motif_id"])


@query(with_views("select motif_id, " + ", ".join(f"round({c}, 5) as {c}" for c in _FEATURES) + " from z", *_ALL, more=f"{_MATRIX}, {_Z}"))
def zscore_columns(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d).select("motif_id", *[F.round(c, 5).alias(c) for c in _FEATURES])


@query(with_views("select motif_id, round(-0.5 + " + " + ".join(f"{c} * {w}" for c, w in _WEIGHTS.items()) + ", 5) as score from z", *_ALL, more=f"{_MATRIX}, {_Z}"))
def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    return matrix.linear_score(_scaled(spark, d), _WEIGHTS, -0.5, ["motif_id"]).withColumn("score", F.round("score", 5))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("score"), (F.col("label") == 0).cast("int").alias("gs"))


_CURVE = """with s as (select vec_id as id, cast(embedding[1] as double) as score, case when label = 0 then 1 else 0 end as gs from embeddings),
r as (select *, row_number() over (order by score desc, id) as rank from s),
k as (select rank, sum(gs) over (order by rank) as hits, (select sum(gs) from s) as p, (select count(*) from s) as n from r),
c as (select rank, hits / rank as prec, hits / p as rec, (rank - hits) / (n - p) as fpr from k)"""


@query(f"{_CURVE} select rank, round(prec, 9) as prec, round(rec, 9) as rec, round(fpr, 9) as fpr from c")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return curves.curve(_scored(spark, d)).select("rank", *[F.round(c, 9).alias(c) for c in ("prec", "rec", "fpr")])


@query(f"""{_CURVE}, e as (select rank, prec, rec, fpr from c union all select 0, prec, 0, 0 from c where rank = 1),
l as (select *, lag(rec) over w as r0, lag(prec) over w as p0, lag(fpr) over w as f0 from e window w as (order by rank))
select round(sum((rec - r0) * (prec + p0) / 2), 9) as aupr, round((select avg(prec) from e where rec >= 0.05 and rec < 0.15), 9) as rec10,
round(sum((fpr - f0) * (rec + r0) / 2), 9) as auroc, round((select avg(rec) from e where fpr >= 0.005 and fpr < 0.015), 9) as fpr1 from l""")
def curve_metrics(spark: SparkSession, d: str) -> DataFrame:
    return curves.metrics(_scored(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("aupr", "rec10", "auroc", "fpr1")])


@query("""with v as (select cast(embedding[1] as double) as value, label % 2 as side from embeddings), n as (select count(*) filter (side = 0) as na, count(*) filter (side = 1) as nb from v),
x as (select value, sum(count(*) filter (side = 0)) over (order by value) as a, sum(count(*) filter (side = 1)) over (order by value) as b from v group by value) select round(max(abs(a / na - b / nb)), 9) as ks from x, n""")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.get("embedding", F.lit(0)).cast("double").alias("value"), (F.col("label") % 2).alias("side"))
    return similarity.ks(v).select(F.round("ks", 9).alias("ks"))


@query("""with v as (select label % 3 as value, vec_id % 2 as side from embeddings), c as (select value, side, count(*) as n from v group by 1, 2),
r as (select value, sum(n) as rn from c group by 1), s as (select side, sum(n) as sn from c group by 1), t as (select sum(n) as tn from c)
select round(tn * (sum(n * n / (rn * sn)) - 1), 6) as chi2, ((select count(*) from r) - 1) * ((select count(*) from s) - 1) as df from c join r using (value) join s using (side) cross join t group by tn""")
def chi2_statistic(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("label") % 3).alias("value"), (F.col("vec_id") % 2).alias("side"))
    return similarity.chi2(v).select(F.round("chi2", 6).alias("chi2"), "df")


_LOG = """lm as (select model, target, ln(value) as value from pairs_y where metric = 5 union all select 'default', target, ln(value) from pairs_y where metric = 9 and model = target)"""
_PW = """pw as (select a.model, case when c.value < 0.8 then 0.9 when a.value / b.value > 1.1 then 1 else 0.9 end as weight from pairs_y a, pairs_y b, pairs_y c
  where a.model = a.target and b.model = a.model and b.target = a.model and c.model = a.model and c.target = a.model and a.metric = 5 and b.metric = 9 and c.metric = 11)"""
_PC = "pc as (select x.model, x.target, x.value - m.m as value from lm x join (select target, avg(value) as m from lm group by 1) m using (target))"


def _y(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pairs_y")


@query(with_views("select model, target, round(value, 9) as value from lm", "pairs_y", more=_LOG))
def pair_log_matrix(spark: SparkSession, d: str) -> DataFrame:
    return mapping.log_matrix(_y(spark, d)).withColumn("value", F.round("value", 9))


@query(with_views("select model, cast(weight as double) as weight from pw", "pairs_y", more=_PW))
def pair_weights(spark: SparkSession, d: str) -> DataFrame:
    return mapping.row_weights(_y(spark, d), 0.9)


@query(with_views("select lm.model, target, round(value * coalesce(weight, 1), 9) as value from lm left join pw using (model)", "pairs_y", more=f"{_LOG}, {_PW}"))
def pair_weighted(spark: SparkSession, d: str) -> DataFrame:
    y = _y(spark, d)
    return mapping.weighted(mapping.log_matrix(y), mapping.row_weights(y, 0.9)).withColumn("value", F.round("value", 9))


@query(with_views("select model, target, round(value, 8) as value from pc", "pairs_y", more=f"{_LOG}, {_PC}"))
def pair_centred(spark: SparkSession, d: str) -> DataFrame:
    return mapping.centred(mapping.log_matrix(_y(spark, d))).withColumn("value", F.round("value", 8))


@query(with_views("select model, target, round(case when model <> 'default' and value <= -2 then -300 else value end, 8) as value from pc", "pairs_y", more=f"{_LOG}, {_PC}"))
def pair_selected(spark: SparkSession, d: str) -> DataFrame:
    return mapping.thresholded(mapping.centred(mapping.log_matrix(_y(spark, d)))).withColumn("value", F.round("value", 8))


@query(with_views("select a.model as high, a.target as low, round((a.value + b.value) / 2, 8) as value from pc a join pc b on a.model = b.target and a.target = b.model where a.model > a.target", "pairs_y", more=f"{_LOG}, {_PC}"))
def pair_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return mapping.symmetric(mapping.centred(mapping.log_matrix(_y(spark, d)))).withColumn("value", F.round("value", 8))


@query(with_views("select x.model, x.target, x.feature, case when ln(pvalue) >= m - 0.5 * s then 1 else 0 end as similar from pairs_x x join (select feature, avg(ln(pvalue)) as m, stddev_samp(ln(pvalue)) as s from pairs_x where model = target group by 1) using (feature) where x.model > x.target", "pairs_x"))
def pair_binary_x(spark: SparkSession, d: str) -> DataFrame:
    return mapping.binary_similarity(view(spark, d, "pairs_x"), 0.5)


@query(with_views("""select target, case when base > value / 0.95 then 'default' else model end as model from
  (select x.*, n.value as base from pc x left join pc n on n.model = 'default' and n.target = x.model where x.model <> 'default' and x.model <> x.target
   qualify row_number() over (partition by x.target order by x.value desc, n.value desc nulls last, x.model desc) = 1)""", "pairs_y", more=f"{_LOG}, {_PC}"))
def best_model_per_target(spark: SparkSession, d: str) -> DataFrame:
    return mapping.best_models(mapping.centred(mapping.log_matrix(_y(spark, d))), 0.95)


_PS = f"""{_LOG}, {_PW}, lw as (select lm.model, target, value * coalesce(weight, 1) as value from lm left join pw using (model)),
ps as (select x.model, x.target, case when x.model <> 'default' and x.value - m <= -2 then -300 else x.value - m end as value from lw x join (select target, avg(value) as m from lw group by 1) using (target))"""


@query(with_views("select model, target, round(value, 8) as value from ps", "pairs_y", more=_PS))
def pair_training_matrix(spark: SparkSession, d: str) -> DataFrame:
    return mapping.selected_matrix(_y(spark, d), 0.9).withColumn("value", F.round("value", 8))


@query("select a.n_name as model, b.n_name as target, a.n_name >= b.n_name as similarity from nation a, nation b")
def sample_pairs(spark: SparkSession, d: str) -> DataFrame:
    return mapping.sample_pairs(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("sample")))


@query(with_views("select model, target, round(value, 8) as value from pc where model not in (select n_name from nation where n_nationkey % 4 = 0) and target not in (select n_name from nation where n_nationkey % 4 = 0)", "pairs_y", more=f"{_LOG}, {_PC}"))
def pair_holdout(spark: SparkSession, d: str) -> DataFrame:
    held = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("sample"))
    return mapping.without_samples(mapping.centred(mapping.log_matrix(_y(spark, d))), held).withColumn("value", F.round("value", 8))


def _regions(spark: SparkSession, d: str) -> list[str]:
    return sorted(r[0] for r in spark.read.parquet(f"{d}/region.parquet").select("r_name").collect())


#: Weight of rows that gain little, and the factor by which a model has to beat the score alone.
_GAMMA = 0.9


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    """Features and training values of pairs, the matrix that results are read from, feature names, and the weighted logs."""
    y, names = _y(spark, d), _regions(spark, d)
    similar = mapping.binary_similarity(view(spark, d, "pairs_x"), 0.5)
    pairs = mapping.assemble(similar, mapping.symmetric(mapping.selected_matrix(y, _GAMMA)), names)
    return pairs, mapping.centred(mapping.log_matrix(y)), names, mapping.weighted(mapping.log_matrix(y), mapping.row_weights(y, _GAMMA))


@query()
def zinb_fit(spark: SparkSession, d: str) -> DataFrame:
    return acc.fit_bootstraps(count_histogram(spark, d), 0)


@query()
def bootstrap_params(spark: SparkSession, d: str) -> DataFrame:
    return acc.mean_parameters(acc.fit_bootstraps(count_histogram(spark, d), 8, 10_000, tolerance=1e-6))


@query()
def simulated_counts(spark: SparkSession, d: str) -> DataFrame:
    from locusframe.kernels.mixture import Mixture

    return acc.simulate_counts(spark, 10_000, Mixture(10, 3, 98, 5, 0.01, 0.89))


@query()
def footprint_calls(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "signal")
    return footprint.footprints(_sites(spark, d), s, s, cutoff=1500.0)


@query(with_views("select motif_id, flank_count as count, case when flank_count >= 1500 then 1e0 else 0e0 end as acces from flanks", "motifs", "signal", more=_FLANKS))
def footprint_calls_known(spark: SparkSession, d: str) -> DataFrame:
    """What footprint_calls knows without its permutations."""
    return footprint_calls(spark, d).select(F.col("id").alias("motif_id"), "count", "acces")


@query()
def footprint_calls_stranded(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "signal")
    return footprint.footprints(_sites(spark, d), s.where("pos % 2 = 0"), s.where("pos % 2 = 1"), cutoff=1500.0, factor=footprint.STRANDED_FLANK, stranded=True)


def _fos(left: str, right: str, factor: str, before: str) -> str:
    """fos of the called sites: for each side, the sum of the binomial probabilities of 0 to the site's cuts, by log-gammas."""
    side = lambda name, cuts, lo, hi: f"""{name} as (select motif_id, cast(floor(coalesce(sum(s.val) filter (s.pos between w.st and w.en), 0)) as bigint) as cent,
  cast(floor(coalesce(sum(s.val * (case when s.pos between {lo} and {hi} - 1 then 1 else 0 end + case when s.pos between {lo} + 1 and {hi} then 1 else 0 end)), 0)) as bigint) as n,
  cast(any_value(w.en - w.st + 1) as double) / any_value({hi} + 1 - {lo}) as p from w left join signal s on s.chrom = w.chrom and s.pos between w.fl and w.fr and {cuts} group by 1)"""  # noqa: E731
    term = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))"
    cdf = lambda name: f"{name}_cdf as (select motif_id, least(1, sum(case when n = 0 then 1 - least(j, 1) else {term} end)) as q from (select *, unnest(range(least(cent, n) + 1)) as j from {name}) t group by 1)"
    return f"""{_FLANKS}, w as (select m.*, greatest(0, st - cast(floor({factor} * (en - st + 1) + 0.5) as bigint)) as fl, en + cast(floor({factor} * (en - st + 1) + 0.5) as bigint) as fr from motifs m join flanks using (motif_id) where flank_count >= 1500),
{side("l", left, "w.fl", "w.en")}, {side("r", right, "w.st", "w.fr")}, {cdf("l")}, {cdf("r")}, {before}"""


_FOS = "fos as (select f.motif_id, flank_count as count, case when flank_count >= 1500 then 1e0 else 0e0 end as acces, round(case when flank_count >= 1500 then a.q * b.q else 1 + 1 / (flank_count + 1) end, 7) as fos from flanks f left join l_cdf a using (motif_id) left join r_cdf b using (motif_id))"


@query(with_views("select * from fos", "motifs", "signal", more=_fos("true", "true", "1.75", _FOS)))
def footprint_scores(spark: SparkSession, d: str) -> DataFrame:
    """What footprint_calls knows without its permutations, scores too."""
    return footprint_calls(spark, d).select(F.col("id").alias("motif_id"), "count", "acces", F.round("fos", 7).alias("fos"))


@query(with_views("select * from fos", "motifs", "signal", more=_fos("s.pos % 2 = 0", "s.pos % 2 = 1", "2.0", _FOS)))
def footprint_scores_stranded(spark: SparkSession, d: str) -> DataFrame:
    return footprint_calls_stranded(spark, d).select(F.col("id").alias("motif_id"), "count", "acces", F.round("fos", 7).alias("fos"))


@query()
def similarity_pvalues(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"), (F.col("label") % 3).alias("c"))
    return similarity.permutation_p(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), ["a", "b", "c"], 500, 10_000, category_size=10_000)


@query()
def fdr_filter(spark: SparkSession, d: str) -> DataFrame:
    return _mappable_sites(spark, d)


@query()
def l1_fit(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    terms = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0])]
    model = training.l1_logistic(e.select((F.col("label") == 0).cast("int").alias("gs"), *[F.get("embedding", F.lit(i)).alias(t) for i, t in enumerate(terms)]), terms)
    return spark.createDataFrame([*model.weights.items(), ("intercept", model.intercept)], "term string, coefficient double")


@query()
def robust_fit(spark: SparkSession, d: str) -> DataFrame:
    pairs, _, names, _ = _pairs(spark, d)
    return mapping.robust_fit(pairs, names, 4.685)


@query()
def mapping_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    pairs, cells, names, logs = _pairs(spark, d)
    return mapping.cross_validate(pairs, cells, names, mapping.grid(), 8, _GAMMA, 1, logs)


@query()
def sample_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth sample is held out: mapped without its performance being known."""
    pairs, cells, names, logs = _pairs(spark, d)
    held = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 8 = 3").select("n_name").collect()]
    return mapping.map_samples(pairs, cells, names, gamma=_GAMMA, logs=logs, held=held)[1]


_MAPPED = """known as (select * from pc where model not in (select n_name from nation where n_nationkey % 8 = 3))
select n_name as target, n_nationkey % 8 = 3 as held_out, round(o.value, 8) as own, round(b.value, 8) as base, round(k.best, 8) as best
from nation left join pc o on o.model = n_name and o.target = n_name left join pc b on b.model = 'default' and b.target = n_name
left join (select target, max(value) as best from known where model <> target group by 1) k on k.target = n_name"""


@query(with_views(_MAPPED.partition("select n_name")[1] + _MAPPED.partition("select n_name")[2], "pairs_y", more=f"{_LOG}, {_PC}, " + _MAPPED.partition("select n_name")[0]))
def sample_mapping_known(spark: SparkSession, d: str) -> DataFrame:
    """What sample_mapping reads from the matrix, whatever the fit: own, default and best value of each target."""
    return sample_mapping(spark, d).select("target", "held_out", *[F.round(c, 8).alias(c) for c in ("own", "base", "best")])


_E = [f"embedding[{i}]" for i in range(1, 5)]
_OWN = pairs_of.LinearModel({"a": 0.7, "b": -0.2, "c": 0.4}, 0.1)
_OTHER = pairs_of.LinearModel({"a": 0.3, "c": -0.9}, -0.2)


def _performance_sql() -> str:
    tables, rows = [], []
    for i, m in enumerate((_OWN, _OTHER, None)):
        score = "d * acces" if m is None else f"{m.intercept} + " + " + ".join(f"{w} * coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0)" for c, w in m.weights.items())
        tables.append(f"""s{i} as (select vec_id as id, {score} as score, gs from v), r{i} as (select *, row_number() over (order by score desc, id) as rank from s{i}),
k{i} as (select rank, sum(gs) over (order by rank) as hits, (select sum(gs) from v) as p, (select count(*) from v) as n from r{i}),
c{i} as (select rank, hits / rank as prec, hits / p as rec, (rank - hits) / (n - p) as fpr from k{i}), e{i} as (select rank, prec, rec, fpr from c{i} union all select 0, prec, 0, 0 from c{i} where rank = 1),
l{i} as (select *, lag(rec) over (order by rank) as r0, lag(prec) over (order by rank) as p0, lag(fpr) over (order by rank) as f0 from e{i})""")
        for k, x in enumerate((f"select sum((rec - r0) * (prec + p0) / 2) from l{i}", f"select avg(prec) from e{i} where rec >= 0.05 and rec < 0.15", f"select sum((fpr - f0) * (rec + r0) / 2) from l{i}", f"select avg(rec) from e{i} where fpr >= 0.005 and fpr < 0.015")):
            rows.append(f"select 'one' as model, 'two' as target, {1 + k + 4 * i} as metric, round(({x}), 6) as value")
    columns = ", ".join(f"cast({e} as double) as {c}" for e, c in zip(_E, "abcd", strict=True))
    return f"with v as (select vec_id, {columns}, label % 2 as acces, case when label = 0 then 1 else 0 end as gs from embeddings),\n" + ",\n".join(tables) + "\n" + " union all ".join(rows)


@query(_performance_sql())
def pair_performance(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcd")]
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), *columns, (F.col("label") % 2).alias("acces"), (F.col("label") == 0).cast("int").alias("gs"))
    return pairs_of.performance_rows("one", "two", v, _OWN, _OTHER, score="d").withColumn("value", F.round("value", 6))


@query(with_views("select motif_id, chrom, st, en from motifs qualify row_number() over (order by md5(concat('7:', cast(motif_id as varchar))), motif_id) <= cast(floor(count(*) over () / 4 + 0.5) as bigint)", "motifs"))
def site_sample(spark: SparkSession, d: str) -> DataFrame:
    """One site in four, those of smallest seeded hash."""
    return matrix.take_share(view(spark, d, "motifs").select("motif_id", "chrom", "st", "en"), 4, 7)


#: Models of the nations, as a table of weights: five terms and a constant.
_NATION_MODELS = """select n_name as model, 'a' as term, cast(n_nationkey * 7 % 11 - 5 as double) / 10 as weight from nation
 union all select n_name, 'b', cast(n_nationkey * 5 % 11 - 4 as double) / 10 from nation union all select n_name, 'c', cast(n_nationkey * 3 % 7 - 2 as double) / 10 from nation
 union all select n_name, 'd', cast(n_nationkey % 5 + 1 as double) / 10 from nation union all select n_name, 'a x b', cast(n_nationkey % 3 as double) / 10 from nation
 union all select n_name, 'intercept', cast(n_nationkey as double) / 100 from nation"""


@query(f"""with m as ({_NATION_MODELS}),
w as (select model, {", ".join(f"max(weight) filter (term = '{t}') as w_{c}" for t, c in (("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a x b", "ab"), ("intercept", "i")))} from m group by model),
v as (select n_name as sample, vec_id as id, {", ".join(f"cast({e} as double) as {c}" for e, c in zip(_E, "abcd", strict=True))}, label % 2 as acces, case when label % 3 = 0 then 1 else 0 end as gs from embeddings join nation on vec_id % 25 = n_nationkey),
x as (select *, a * b as ab from v),
z as (select sample, id, gs, {", ".join(f"coalesce(({c} - avg({c}) over k) / nullif(stddev_samp({c}) over k, 0), 0) as z_{c}" for c in ("a", "b", "c", "d", "ab"))} from x window k as (partition by sample)),
s as (select model, sample as target, id, w_i + z_a * w_a + z_b * w_b + z_c * w_c + z_d * w_d + z_ab * w_ab as score, gs from z cross join w union all select '', sample, id, d * acces, gs from v),
r as (select *, row_number() over (partition by model, target order by score desc, id) as rank, sum(gs) over (partition by model, target) as p, count(*) over (partition by model, target) as n from s),
k as (select *, sum(gs) over (partition by model, target order by rank) as hits from r),
c as (select model, target, rank, hits / rank as prec, hits / nullif(p, 0) as rec, (rank - hits) / nullif(n - p, 0) as fpr from k),
e as (select * from c union all select model, target, 0, prec, 0, 0 from c where rank = 1),
l as (select *, lag(rec) over o as r0, lag(prec) over o as p0, lag(fpr) over o as f0 from e window o as (partition by model, target order by rank)),
g as (select model, target, [sum((rec - r0) * (prec + p0) / 2), avg(prec) filter (rec >= 0.05 and rec < 0.15), sum((fpr - f0) * (rec + r0) / 2), avg(rec) filter (fpr >= 0.005 and fpr < 0.015)] as numbers from l group by model, target),
q as (select a.n_name as model, b.n_name as target, i, case i when 0 then b.n_name when 1 then a.n_name else '' end as who from nation a cross join nation b cross join (values (0), (1), (2)) t(i))
select q.model, q.target, cast(1 + 4 * i + j as int) as metric, round(numbers[j + 1], 6) as value from q left join g on g.model = q.who and g.target = q.target cross join (values (0), (1), (2), (3)) t(j)""")
def all_pair_performance(spark: SparkSession, d: str) -> DataFrame:
    """Twelve numbers for every pair of nations, each with the vectors of its key and a model of its own."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    columns = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcd")]
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *columns, (F.col("label") % 2).alias("acces"), (F.col("label") % 3 == 0).cast("int").alias("gs"))
    data = vectors.join(nation, F.col("vec_id") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("sample"), F.col("vec_id").alias("id"), *"abcd", "acces", "gs")
    pairs = view(spark, d, "pairs_y").select("model", "target").distinct()
    return pairs_of.performance(data, spark.sql(_NATION_MODELS), pairs, list("abcd"), products=True, score="d").withColumn("value", F.round("value", 6))


@query()
def all_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Permutation tests of three features for every pair of regions, each with the vectors of its key, itself included."""
    region = spark.read.parquet(f"{d}/region.parquet")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 5).alias("key"), F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"), (F.col("label") % 3).alias("c"))
    data = e.join(region, F.col("key") == F.col("r_regionkey")).select(F.col("r_name").alias("sample"), "a", "b", "c")
    return pairs_of.similarity(data, mapping.sample_pairs(region.select(F.col("r_name").alias("sample"))), list("abc"))


@query(f"""with v as (select r_name as sample, cast({_E[0]} as double) as a, cast({_E[1]} as double) as b, cast(label % 3 as double) as c from embeddings join region on vec_id % 5 = r_regionkey),
l as (select sample, feature, value from v unpivot (value for feature in (a, b, c))),
s as (select sample, feature, count(*) as rows from l group by 1, 2)
select m.sample as model, t.sample as target, feature, case when levels <= 6 then 'chi2' else 'ks' end as kind, cast(least(m.rows, t.rows, case when levels <= 6 then 10000 else 500 end) as int) as n
from s m join s t using (feature) join lateral (select count(distinct value) as levels from l where l.feature = m.feature and l.sample in (m.sample, t.sample)) on true where m.sample >= t.sample""")
def all_pair_similarity_known(spark: SparkSession, d: str) -> DataFrame:
    """What all_pair_similarity knows without its permutations: each pair's kind of test, and rows of a sub-sample."""
    return all_pair_similarity(spark, d).select("model", "target", "feature", "kind", "n")


@query(f"""with v as (select n_name as sample, cast({_E[0]} as double) as a, cast({_E[1]} as double) as b, cast(label % 3 as double) as c from embeddings join nation on vec_id % 25 = n_nationkey),
l as (select sample, feature, value from v unpivot (value for feature in (a, b, c))), p as (select a.n_name as model, b.n_name as target from nation a join nation b on a.n_name >= b.n_name),
x as (select model, target, feature, value, sum(one) as a, sum(two) as b from (select model, target, feature, value, 1 as one, 0 as two from p join l on sample = model union all select model, target, feature, value, 0, 1 from p join l on sample = target) group by 1, 2, 3, 4),
y as (select *, sum(a) over w as ca, sum(b) over w as cb, sum(a) over k as na, sum(b) over k as nb, count(*) over k as levels from x window w as (partition by model, target, feature order by value), k as (partition by model, target, feature))
select model, target, feature, case when levels <= 6 then 'chi2' else 'ks' end as kind,
  round(case when levels <= 6 then (max(na) + max(nb)) * (sum(a * a / ((a + b) * na) + b * b / ((a + b) * nb)) - 1) else max(abs(ca / na - cb / nb)) end, 8) + 0e0 as statistic, cast(case when levels <= 6 then levels - 1 end as int) as df
from y group by model, target, feature, levels""")
def all_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Two-sample statistics of three features for every pair of nations, each with the vectors of its key, itself included."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 25).alias("key"), F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"), (F.col("label") % 3).alias("c"))
    data = e.join(nation, F.col("key") == F.col("n_nationkey")).select(F.col("n_name").alias("sample"), "a", "b", "c")
    pairs = mapping.sample_pairs(nation.select(F.col("n_name").alias("sample"))).where("model >= target")
    return pairs_of.statistics(data, pairs, list("abc")).withColumn("statistic", F.round("statistic", 8) + F.lit(0.0))
