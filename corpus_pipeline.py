"""Corpus preparation in five stages, each one operator over all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the
packed pieces. ``run`` applies them to the documents of a folder; every stage's result is
written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import language_id, line_dedup, mixing, ngram_join, packing
from cohortia.llm.queries import MIX_TARGETS, byte_tokens, domain_labels
from cohortia.session import stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are in no learned language: letterless ones and unknown n-grams."""
    return language_id.keep_known(docs, language_id.learn(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that equal an earlier one, or are one edit away, and without documents that
    had words and have none left."""
    found = line_dedup.dedup_lines(docs).filter("n_lines = 0 OR n_lines > n_equal + n_near")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return ngram_join.one_of_each(docs)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of the domains that are short of words more often."""
    return mixing.mixed(docs, domain_labels(spark, sf_dir), MIX_TARGETS, least=1.0, grow=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sequence and a place in it for every piece of every document."""
    return packing.pack(packing.pieces(docs, **byte_tokens()))


STAGES = [
    ("language ID", known_languages),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources to target weights", mixed_to_targets),
    ("best-fit packing", packed),
]

# Learned models and the tokenizer are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
