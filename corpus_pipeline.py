"""The corpus pipeline: stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as it leaves them,
with the columns of the documents table; the last returns the packed pieces.  Between stages the
rows are written as Parquet below ``spark.checkpoint.dir`` and read again, so that no stage repeats
another's work.

1. quality rules: documents that fail the base rules or are mostly boilerplate go, and boilerplate
   lines are removed from the others;
2. toxicity: documents that the classifier reports go;
3. near duplicates: one document of each group of linked fingerprints stays;
4. secrets: their spans are masked in the text;
5. packing: the texts' pieces are placed in sequences.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quayline.llm import line_quality, packing, secret_scan, simhash, toxicity
from quayline.llm.common import documents, stored
from quayline.llm.queries import vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.cleaned(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.SHINGLE_WORDS, simhash.MAX_BITS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = Path(vocabulary_file("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.packed(docs, vocabulary, packing.CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", masked_secrets),
    ("best_fit_packing", packed_sequences),
]

# XXH64 fingerprints, the classifier and the tokenizer are outside SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
