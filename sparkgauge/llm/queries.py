"""One query per operator over its whole table, with production parameters."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from sparkgauge.llm import (
    bpe,
    collocations,
    decontamination,
    embedding_dedup,
    hard_negatives,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    oracle,
    quality_fm,
    toxicity,
    warc_writer,
)
from sparkgauge.llm.shared import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(read(spark, sf_dir, "documents"), fold=4, held=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_writer.round_trip(read(spark, sf_dir, "pages"), least_revisit=0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(read(spark, sf_dir, "documents")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.load(bpe.TOKENIZER)
    return bpe.digests(bpe.encode_decode(read(spark, sf_dir, "documents"), model))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.predictions(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold=5, cut=0.3
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold=5, cut=0.5
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read(spark, sf_dir, "documents"), fold=10, held=0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.relabelled(read(spark, sf_dir, "embeddings")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), least=100, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_warc": op6_warc,
        "op7_license_scan": op7_license_scan,
        "op8_bpe": op8_bpe,
        "op9_quality_fm": op9_quality_fm,
        "op10_toxicity": op10_toxicity,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
