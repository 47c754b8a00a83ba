"""An extension of our own: counts of a growing directory of reads with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.operators.kmers import enumerate_kmers, split_runs


def stream_counts(spark: SparkSession, directory: str, k: int, canonical: bool = True) -> DataFrame:
    """A streaming (kmer, cnt) of line-per-read files; write it in complete or update mode."""
    lines = spark.readStream.text(directory).select(F.col("value").alias("seq"))
    return enumerate_kmers(split_runs(lines, k), k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))
