"""A corpus pipeline over documents: drop bad texts, near copies and benchmark passages, mix the sources, write token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each stage's result as Parquet in the shared folder and reads
it again as the next one's docs. Labels and benchmark come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, jaccard, mixing, quality, token_store
from folioflow.llm.common import shared_dir, written


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages they share with the benchmark; n_chars follows the text."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_sources(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files of token ids."""
    path = f"{shared_dir(spark)}/tokens"
    token_store.write_store(docs, path)
    return token_store.read_store(spark, path)


STAGES = [("quality classifier", drop_bad), ("n-gram jaccard join", drop_near_copies), ("benchmark decontamination", cut_benchmark), ("mixing sources", mix), ("token id output", write_ids)]

#: A trained classifier and a tokenizer have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
