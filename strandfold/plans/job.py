"""The whole job: reads, counts in the format asked for, side outputs and totals; or either of its two phases alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from strandfold.functions import bases
from strandfold.operators import kmers
from strandfold.operators.kmers import KmerConfig, words_of
from strandfold.plans import staged
from strandfold.sources import fastx, packed

FORMATS = ("packed", "fasta", "none")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Totals:
    """What a job has seen. Numbers of a phase that did not run are None; reads are rows of the source."""

    reads: int | None
    bases: int | None
    kmers: int
    ukmers: int
    below_threshold: int


@dataclass(frozen=True)
class Done:
    """The k-mers that reach the threshold (kmer, cnt), the totals, and the table of all counts that both come from
    (bin if staged, words of the k-mer, cnt), which release() deletes."""

    kept: DataFrame
    totals: Totals
    counts: DataFrame
    path: str

    def release(self) -> None:
        delete(self.counts.sparkSession, self.path)


def _observed(reads: DataFrame) -> tuple[DataFrame, Observation]:
    """(reads, their number and bases, known once they have been read). The observation sees each row as it passes."""
    seen = Observation(f"reads-{uuid.uuid4().hex}")
    letters = F.length("seq") - F.length(F.translate("seq", bases.BASES + bases.BASES.lower(), ""))
    return reads.select("seq").observe(seen, F.count("*").alias("reads"), F.coalesce(F.sum(letters), F.lit(0)).cast("bigint").alias("bases")), seen


def _count(spark: SparkSession, counts: DataFrame, reads: Observation | None, config: KmerConfig) -> Done:
    """Write all counts once; totals are observed on the way."""
    path, seen = scratch(spark, "counts"), Observation(f"counts-{uuid.uuid4().hex}")
    zero = F.lit(0).cast("bigint")
    totals = F.coalesce(F.sum("cnt"), zero).alias("kmers"), F.count("*").alias("ukmers"), F.count_if(F.col("cnt") < config.min_count).alias("below_threshold")
    _compact(counts.observe(seen, *totals)).parquet(path)
    stored = spark.read.schema(counts.schema).parquet(path)
    kept = kmers.at_least(stored, config.min_count).select(kmers.spelled(config.k).alias("kmer"), "cnt")
    of_reads = reads.get if reads else {"reads": None, "bases": None}
    return Done(kept, Totals(**of_reads, **seen.get), stored, path)


def bin_stats(spark: SparkSession, counts: DataFrame | None, staging: str, config: KmerConfig) -> DataFrame:
    """(bin, smers, kmers, ukmers, bases) of the bins in use: what was staged, and the different k-mers counted."""
    rows = staged.read_staged(spark, staging, config)
    smers, windows = F.col("smers") * F.col("copies"), F.col("n_kmers") * F.col("copies")
    own = rows.groupBy("bin").agg(F.sum(smers).alias("smers"), F.sum(windows + (config.k - 1) * smers).alias("bases"))
    if counts is None:
        of_kmers = staged.part_stats(rows, config.k, config.canonical).groupBy("bin").agg(F.sum("kmers").alias("kmers"), F.sum("ukmers").alias("ukmers"))
    else:
        of_kmers = counts.groupBy("bin").agg(F.sum("cnt").alias("kmers"), F.count("*").alias("ukmers"))
    return own.join(of_kmers, "bin").select("bin", "smers", "kmers", "ukmers", "bases")


def write_bin_stats(spark: SparkSession, staging: str, config: KmerConfig, path: str, counts: DataFrame | None = None) -> None:
    """One line a bin in order, tab-separated: bin, super-mers, k-mers, distinct k-mers, bases; empty bins too."""
    every = spark.range(config.bins).withColumnRenamed("id", "bin").join(bin_stats(spark, counts, staging, config), "bin", "left")
    columns = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("bin", "smers", "kmers", "ukmers", "bases")]
    every.orderBy("bin").coalesce(1).select(F.concat_ws("\t", *columns).alias("line")).write.text(path)


def _reads(spark: SparkSession, reads: str | DataFrame, config: KmerConfig) -> DataFrame:
    return fastx.read_for_counting(spark, reads, config.k) if isinstance(reads, str) else reads


def _write(done: Done, out: str | None, config: KmerConfig, format: str, histogram: str | None) -> None:
    if histogram:
        kmers.write_histogram(kmers.histogram(done.counts), histogram)
    if format == "packed":
        packed.write_packed(done.kept, out, config.k)
    elif format == "fasta":
        packed.write_fasta(done.kept, out)


def _checked(format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")


def stage(spark: SparkSession, reads: str | DataFrame, staging: str, config: KmerConfig = KmerConfig()) -> None:
    """The first phase alone: reads (a path, or rows with seq) as bins at `staging`, with a manifest of their parameters."""
    staged.stage_supermers(_reads(spark, reads, config), config, staging)


def count_bins(spark: SparkSession, staging: str, out: str | None, min_count: int = 3, canonical: bool | None = None, format: str = "packed", histogram: str | None = None, bin_stats: str | None = None) -> Done:
    """The second phase alone, from what an earlier session staged: any threshold, format and side outputs, and plain counts
    of bins that were staged canonically. All other parameters are those of the manifest."""
    _checked(format)
    config = staged.staged_config(spark, staging, min_count, canonical)
    counts = staged.count_parts(staged.read_staged(spark, staging, config), config.k, config.canonical)
    done = _count(spark, counts, None, config)
    _write(done, out, config, format, histogram)
    if bin_stats:
        write_bin_stats(spark, staging, config, bin_stats, done.counts)
    return done


def execute(spark: SparkSession, reads: str | DataFrame, out: str | None, config: KmerConfig = KmerConfig(), format: str = "packed", staging: str | None = None, histogram: str | None = None, bin_stats: str | None = None) -> Done:
    """Count reads (a path, or rows with seq) and write the k-mers that reach the threshold to `out` as `packed`, `fasta` or
    `none`.

    Without staging the reads are passed once: all totals are observed in that pass. staging: super-mers are written there
    by bin and counted from there; the reads are passed twice, once for the bins' sizes, and their totals are not taken.
    histogram, bin_stats: folders of those text files; bin_stats needs staging.
    """
    _checked(format)
    if bin_stats and not staging:
        raise ValueError("bin statistics are those of staged bins")
    if staging:
        stage(spark, reads, staging, config)
        return count_bins(spark, staging, out, config.min_count, config.canonical, format, histogram, bin_stats)
    own, seen = _observed(_reads(spark, reads, config))
    done = _count(spark, kmers.count_packed(own, config.k, config.canonical), seen, config)
    _write(done, out, config, format, histogram)
    return done


def run(spark: SparkSession, reads: str | DataFrame, out: str | None, config: KmerConfig = KmerConfig(), format: str = "packed", staging: str | None = None, histogram: str | None = None, bin_stats: str | None = None) -> DataFrame:
    """execute(); returns the k-mers that reach the threshold as (kmer, cnt)."""
    return execute(spark, reads, out, config, format, staging, histogram, bin_stats).kept


def _compact(rows: DataFrame) -> DataFrameWriter:
    """A writer of counts: their words come in order, so Parquet's second version writes them by their differences."""
    return rows.write.option("parquet.writer.version", "v2")


def add_reads(spark: SparkSession, reads: str | DataFrame, table: str, config: KmerConfig = KmerConfig()) -> None:
    """Count reads into the table of counts at `table` (Parquet by bin; made if it does not exist), as if all reads so far had
    been counted at once. Only the bins that the new reads touch are written again.

    A new table is written at once, without a copy. Else the merged bins are complete in the shared folder before any of the
    table's is replaced, and replacing them again gives the same table, so a run that was lost meanwhile may be repeated from
    there, not from its reads.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    staging = scratch(spark, "staged")
    stage(spark, reads, staging, config)
    rows = staged.read_staged(spark, staging, config)
    counts = staged.count_parts(rows, config.k, config.canonical)
    if not exists:
        _compact(counts).partitionBy("bin").parquet(table)
        delete(spark, staging)
        return
    stored = spark.read.parquet(table).select(F.col("bin").cast("bigint").alias("bin"), *words_of(config.k), "cnt")
    merged = scratch(spark, "merged")
    # At most one row for each bin.
    touched = F.broadcast(rows.select("bin").distinct())
    both = counts.unionByName(stored.join(touched, "bin", "left_semi")).repartition("bin")
    _compact(both.groupBy("bin", *words_of(config.k)).agg(F.sum("cnt").alias("cnt")).sortWithinPartitions("bin", *words_of(config.k))).partitionBy("bin").parquet(merged)
    delete(spark, staging)
    rows = spark.read.parquet(merged).select(*words_of(config.k), "cnt", "bin")
    _compact(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bin").parquet(table)
    delete(spark, merged)


def read_counts(spark: SparkSession, table: str, config: KmerConfig = KmerConfig()) -> DataFrame:
    """(kmer, cnt) of a table of counts that reach the threshold."""
    return kmers.at_least(spark.read.parquet(table), config.min_count).select(kmers.spelled(config.k).alias("kmer"), "cnt")
