"""Corpus pipeline: quality rules, near duplicates, decontamination, PII, source mix.

Each stage works on all rows its predecessor kept, and its decisions take effect. ``run``
writes every stage to the shared folder and reads it again, so a lost executor never costs
more than the stage it is in; what a stage kept for itself there is deleted once it is written.

Defined results for odd input: null and empty texts have no words, which the quality rules
reject, so none reaches the later stages; each stage by itself keeps them (no links, no benchmark
words, nothing to redact, size 0). Of equal texts under several ids the smallest id stays; rows
that repeat an id and its text all stay, being one document; a null id is no document to compare,
and its row stays. A text under an id that also stands on a copy stays, the copy goes. Null sources
are a source of their own in the mix. Very long texts are read whole. Columns that the stages don't
know pass through, whatever their names. An empty table gives an empty table, an empty benchmark
removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import store
from sparkveil.llm.decontaminate import remove_contaminated
from sparkveil.llm.jaccard import NEAR, keep_one
from sparkveil.llm.mixing import mix
from sparkveil.llm.pii import redact
from sparkveil.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard 0.8) the one with the smallest id stays."""
    return keep_one(docs, rule=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document, and their training position."""
    return mix(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("source_mix", source_mix)]

#: The quality verdict, and the spans that boosted trees add, can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = store.made()
        path = store.new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        store.release(spark, since, keep=(path,))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
