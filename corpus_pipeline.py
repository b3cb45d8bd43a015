"""From raw documents to token ids, in five stages.

1. quality classifier: documents that it rejects, as junk or as toxic, go;
2. SimHash near-duplicates: one document of each group stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. personal data: entities get surrogates, and n_chars follows the text;
5. BPE: the texts that are left become token ids.

All stages but the last return the columns of ``documents``.  Each is written
as Parquet and read again by the next, so nothing is computed twice and a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, pii, quality_model, simhash
from graphloom.llm.common import documents, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs)
    if "n_chars" not in out.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", token_ids),
]

#: None of the stages can be expressed in SQL; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
