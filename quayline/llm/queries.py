"""The package's registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quayline.llm import (
    byte_bpe, html_extract, licenses, line_quality, merkle, packing, ranked_search, secret_scan, sharding, simhash, sketches,
    toxicity, warc,
)
from quayline.llm.common import documents


def vocabulary_file(name: str) -> str:
    """Where the installed vocabulary files are; operators take the contents."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(vocabulary_file("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.packed(documents(spark, sf_dir), vocabulary, packing.CAPACITY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir), simhash.SHINGLE_WORDS, simhash.MAX_BITS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(documents(spark, sf_dir))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), sharding.even(sharding.SHARDS))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compared(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = Path(vocabulary_file("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return byte_bpe.digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(documents(spark, sf_dir))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


QUERIES = {
    query.__name__: query
    for query in (
        op1_best_fit_packing, op2_simhash, op3_toxicity, op4_line_quality, op5_secret_scan, op6_license_scan,
        op7_rendezvous_shards, op8_scaled_sketch, op9_byte_bpe, op10_warc_derivatives,
        op11_merkle_manifest, op12_main_text, op13_ranked_search,
    )
}
