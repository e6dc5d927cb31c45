"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fertility, jaccard, lm, mixing, packing, quality, spm, substring, warc

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 100 == 0)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = labels.select("doc_id", quality.rating(labels["quality"], labels["toxic"]).alias("grade"))
    return quality.select_quality(_docs(spark, sf_dir), rated)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_docs(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir), copy="copy")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_pieces(_docs(spark, sf_dir), round_trip=True)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_docs(spark, sf_dir))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(_docs(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_ann": op1_ann,
        "op2_lm": op2_lm,
        "op3_quality": op3_quality,
        "op4_substring": op4_substring,
        "op5_warc": op5_warc,
        "op6_mixing": op6_mixing,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_jaccard": op8_jaccard,
        "op9_fertility": op9_fertility,
        "op10_packing": op10_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.MIX_SQL}
