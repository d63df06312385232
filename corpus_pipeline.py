"""A training-data pipeline over documents: each stage applies one operator to what the stage before it kept.

toxicity drops documents that score as toxic; near_duplicates leaves one document of each group (five-word shingles, similarity 0.8); decontamination drops documents
that hold a benchmark window; secrets masks what it finds; tokens encodes the texts that are left.

Null and empty texts pass every stage (their lists of ids are empty); rows that repeat an id are one document to near_duplicates and rows of their own to the others;
rows of a null id stay. Columns besides those of documents go through all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import bpe, decontam, jaccard, secrets
from loomstone.llm import toxicity as toxic
from loomstone.llm.common import long_rows, shared_folder

#: Near duplicates share this many hundredths of their shingles of so many words; op5 has its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return toxic.drop_toxic(docs, toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return jaccard.keep_one(docs, percent=NEAR_PERCENT, shingle=NEAR_SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return secrets.redact_secrets(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return bpe.bpe_encode(docs, bpe.default_vocabulary()).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("tokens", tokens)]
#: Learnt scores and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns. What a stage returns is written to the shared folder and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # what the stage before it has written is read for the last time
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
