"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Rejected documents go at the quality stage, near duplicates and benchmark copies at the next two, then the sources are
mixed to their target weights, and the last stage writes token ids in binary shards and reports each document from them.
Stages keep rows without a doc_id unless their own text is what they reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewise.llm.common import read_table, run_folder, setup
from placewise.llm.decontaminate import keep_clean
from placewise.llm.mixture import mixed_documents
from placewise.llm.neardup import keep_one
from placewise.llm.quality import keep_good
from placewise.llm.tokens import token_ids

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"), cut=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs, size=5, percent=85)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: one row per document and round of the mix that takes words of it."""
    return mixed_documents(docs)


def binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; (doc_id, start, n_tokens, ids_crc32) of every row, read back from them."""
    import public_tokenizers

    return token_ids(docs, public_tokenizers.path(TOKENIZER), end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", binary_output),
]

# A network, signatures and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    setup(spark)
    docs = read_table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
