"""Documents to packed training sequences: quality rules, near-duplicates, benchmark passages, secrets, packing.

Every stage is a function (spark, docs, sf_dir) whose result is written as Parquet in the shared
folder and read again as the next one's documents, so a lost executor repeats one stage at most.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threatloom.llm import decontam, packing, quality, secret_scan, simhash
from threatloom.llm.common import new_folder, table

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are boilerplate on their host."""
    return quality.clean_documents(docs, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return simhash.keep_one(docs, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced in the text; every document stays."""
    return secret_scan.redact(docs, chars_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), keep_cache=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secrets", secrets),
    ("packing", packed),
]

# Fingerprints, guess costs and tokens are beyond SQL; tests/llm compares with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
