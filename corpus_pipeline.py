"""A corpus from raw documents to packed sequences, in five stages.

Each stage gets what the one before it kept, as a table, and all but the last return the
columns of documents: toxic documents go, one of each group of near copies stays, passages
that repeat are cut out, sources are mixed to their target weights (a document appears as
often as the mix takes it), and what is left is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorakana.llm import mixing, neardup, packing, suffixes, toxicity
from sorakana.llm.common import shared_dir
from sorakana.llm.encoding import tokenizer_json

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_clean(docs, toxicity.train(docs, labels)).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs).select(*COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(docs, keep=("doc_id", "lang", "source"), texts=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_json("byte_bpe_50k.json"))


STAGES = [("toxicity", remove_toxic), ("minhash_neardup", remove_near_duplicates), ("suffix_dedup", remove_passages), ("source_mixing", mix_sources), ("best_fit_packing", pack)]
#: The model, the odd sketches and the packing aren't SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
