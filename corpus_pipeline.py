"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.  A
filtering stage returns the columns of documents unchanged; the secret stage changes the texts that hold live secrets; the
last returns the mix: how often each document that is left is taken.

Defined results: null, empty and letterless texts go with the language stage; of rows that are equal in id and text one
stays; a null doc_id, lang or source is kept as null; without a labelled row every text with a letter stays; an empty table
gives an empty table; further columns of documents are carried along by all stages but the last; very long texts are worked
on whole.  What each operator does with such rows stands in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, language_id, mixing, ngram_join, secret_scan
from framewright.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which no language can be told, or none with a score of 0.5 or more."""
    return language_id.accepted(docs, language_id.train(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return ngram_join.one_of_each(docs, ngram_join.ngram_join(docs, spanning=True))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are blotted out; the documents stay."""
    return secret_scan.redacted(docs, secret_scan.secret_scan(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left: ``doc_id, size, source_size, target, taken``."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("mix", mix)]

#: SQL can express neither the classifier nor the graph.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
