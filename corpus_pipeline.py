"""The corpus pipeline: each stage calls one operator of strandfold.llm on all that its predecessor kept.

run(spark, sf_dir) applies STAGES to the table documents; each stage's result is written as Parquet in the shared folder
and read again as the next one's input, and deleted once the next one is written. ORACLE_SQL is None: neither the trained
network, the near-copy components nor the byte-level tokens can be had from SQL. A test compares each stage, on what its
predecessor kept of the smallest table, with brute force (the language stage by its contract only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm import decontaminate, langid, neardup, packing, pii
from strandfold.llm.common import discard, written
from strandfold.llm.entries import CAPACITY, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network identifies; null texts and texts without a letter go."""
    return langid.keep_known(docs, langid.train(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return neardup.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts; n_chars follows the text."""
    clean = pii.sanitise(docs, out="pii_spans", clean="clean_text")
    columns = [F.col("clean_text").alias("text") if c == "text" else F.when(F.size("pii_spans") > 0, F.length("clean_text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return clean.select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of the texts that are left."""
    pieces = packing.pack(docs, tokenizer_path(), capacity=CAPACITY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        following = written(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
