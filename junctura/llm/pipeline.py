"""A pipeline over the documents: each stage is written as Parquet and read again as the next one's input.

Quality rules and the quality classifier drop documents, the n-gram Jaccard join keeps one document of
each group, the mix drops or repeats documents by their source's target, and the last stage adds token
ids and what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, host_rules, mixing, near_join, quality, shared
from .queries import may_learn, tokenizer_path

#: The stage's near copies: word shingles of five, similarity 0.8 or more. The contract's four and 85 bind op8's query only.
WORDS = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, shared.table(spark, sf_dir, "labels"), may_learn)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep(docs, words=WORDS, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mix_sources),
    ("bpe", bpe_tokens),
]

#: SQL can't express the classifier's fit; tests hold the pipeline against its parts by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
