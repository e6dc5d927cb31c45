"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet to the shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colstrata.llm import fertility, jaccard, mixing, spm, substring
from colstrata.llm.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokeniser figures lie in the bands of their language."""
    return fertility.fertility_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of one document of each group of near duplicates."""
    return jaccard.drop_near_duplicates(docs, once=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier already."""
    return substring.cut_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document."""
    return spm.encode_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: Tokenisers and suffix order are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents table after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.split()[0].lower())
    return docs
