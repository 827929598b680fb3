"""A training corpus from documents, in stages that are each written and read again.

Rejected and repeated documents go, contaminated ones too; the rest is packed.
Every stage but the last returns the columns it gets, whatever their names.

Nulls: a document without words is rejected by the first stage; a null language is
judged by the model of all; a null id is not trusted as a label, counts after all
other ids in a group of near-duplicates, and is packed as null. Rows with the same
id are judged one by one, and of those with the same id and text one stays. Of a
group, the smallest id stays. A document at a limit is kept. Without labels the
first stage keeps all with words and the second goes by its base rules. An empty
table passes all stages and gives no rows; texts of any length are read whole.

Stages set the session's rows per batch for Python and leave it so, as their results
are read later; ``run`` puts the caller's setting back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import decontam, isoforest, kneser_ney, packing, simhash
from lakeweave.llm.common import materialize
from lakeweave.llm.tokens import public_path


#: Several stages share a worker's memory: rows in a batch of texts, and units it keeps the ids of.
BATCH_ROWS, UNITS = 2000, 400_000


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    _small_batches(spark)
    return kneser_ney.keep_good(docs, kneser_ney.fit(docs, _labels(spark, sf_dir)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    _small_batches(spark)
    return isoforest.keep_good(docs, isoforest.fit(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that fingerprints link."""
    _small_batches(spark)
    return simhash.keep_one(docs, radius=3, width=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many words from benchmark items."""
    _small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=13, one_in=20, remove="documents")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its place in a sequence."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), end_id=0, capacity=2048, max_units=UNITS, keep_units=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Models and tokenisers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)  # has read all texts when it returns
    finally:
        spark.conf.set(BATCH_SETTING, before)
