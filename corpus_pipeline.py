"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing sources to target weights, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import common, line_dedup, mixing, ngram_join, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of kept documents, two long columns, are broadcast up to so many.
BROADCAST_IDS = 500_000
#: Bytes of the texts that go to a Python worker at once: the JVM and the worker both hold them, in executors that run all stages.
BATCH_BYTES = "8m"
_scratch: list[str] = []


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more; the model is fitted to labels outside the held-out fifth."""
    labels = common.table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.score(docs, toxicity.train(docs, labels), keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that occur earlier; documents of which only white space is left after that go too."""
    out = line_dedup.line_dedup(docs, keep=COLUMNS)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^ \t\r\n]")
    return out.where(~emptied).select("doc_id", F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept")).alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the least id. Rows without id stay; of rows that repeat a kept id, equal texts stay once."""
    found = ngram_join.jaccard_components(docs).where("doc_id is not null and component_id = doc_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"))
    found = common.materialise(found, "kept")
    few = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(found) if few else found, F.col("doc_id") == F.col("kept_id"))
    once, more = kept.where("rows = 1").select(*COLUMNS), kept.where("rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return once.unionAll(more).unionAll(docs.where("doc_id is null").select(*COLUMNS))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document once at least, and those of small sources up to twice. The copies come by block and slot, so packing reads the mixed order. Null sources are one source; an empty table stays empty."""
    return mixing.mix(docs, keep=[c for c in COLUMNS if c != "source"]).select(*COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in pieces of at most 1024 tokens; empty and null texts are one end id, an empty table gives no rows."""
    return packing.pack(docs)


def _clean(stage: Callable) -> Callable:
    """A stage starts when the one before it has been written, so what that one left in the shared folder goes."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_tables(spark, _scratch)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        out, written = common.recorded(lambda: stage(spark, docs, sf_dir))
        _scratch.extend(written)
        return out

    return run


STAGES = [(name, _clean(f)) for name, f in (("toxicity", _toxicity), ("line dedup", _line_dedup), ("n-gram Jaccard join", _ngram_join), ("mixing", _mixing), ("packing", _packing))]

#: Training, hashed permutations and token ids aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents").select(*COLUMNS), []
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.drop_tables(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
