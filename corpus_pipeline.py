"""From raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

The order: texts that the quality classifier rejects go, one text of each group of near-duplicates stays, documents
that hold benchmark passages go, personal data get surrogates, and what is left is encoded.

Defined results, beyond those of the operators: null and empty texts pass the classifier and are near-duplicates of each
other, so one of them stays; rows without an id are documents like others; of rows that repeat id and text one stays; without labels the
classifier keeps everything, without a benchmark nothing is contaminated; an empty table gives no row. The first four stages return all
columns of documents, whatever their names; the last one returns ids and digests per document.

A stage deletes what earlier stages made in the shared folder on the way: by then their results have been written and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import bpe, decontaminate, pii, resample, simhash
from anamnesis.llm.common import held, release, remove, scratch, table

PII_KEY = "surrogates-1"
#: Scratch tables that the stages have made.
made: set[str] = set()


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs, made)
        before = set(held)
        out = stage(spark, docs, sf_dir)
        made.update(held - before)
        return out

    return run


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = resample.resample(docs, table(spark, sf_dir, "labels"))
    return kept.select(*docs.columns)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, words=5)


@tidy
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), size=10, how="document")


@tidy
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, PII_KEY)


@tidy
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("surrogates", surrogates), ("bpe", encoded)]
#: The stages' models, links and merges can't be put as SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), ""
    for _, stage in STAGES:
        at = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        remove(spark, last)
        last = at
    return docs
