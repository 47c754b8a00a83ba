"""Reads from FASTA, FASTQ and line-per-read files, plain, gzip or bzip2, from any storage that Spark reads.

All go through Spark's text reader, which decompresses, and splits plain and bzip2 files; fastq.py finds records in splits
that begin anywhere, blocks.py reads block-structured gzip in parallel. read_sequences() gives a read as one row; ranges.py
gives long plain FASTA records in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.sources import blocks, fastq, ranges

# Extensions of types and codecs, case-sensitive.
TYPES = {"fastq": "fastq", "fq": "fastq", "fasta": "fasta", "fa": "fasta", "ml": "lines"}
CODECS = {"gz": "gzip", "bz2": "bzip2"}


def file_kind(path: str) -> tuple[str, str]:
    """(type, codec) by the extensions, case-sensitive; type `unknown` for others."""
    name, _, last = path.rpartition("/")[2].rpartition(".")
    codec = CODECS.get(last, "none")
    if codec != "none":
        last = name.rpartition(".")[2]
    return TYPES.get(last, "unknown"), codec


def kind_columns(name: Column) -> tuple[Column, Column]:
    """(type, codec) of a column of paths, as file_kind()."""
    last = F.element_at(F.split(name, "/"), -1)
    codec = F.coalesce(*(F.when(last.endswith("." + x), c) for x, c in CODECS.items()), F.lit("none"))
    inner = F.when(codec == "none", last).otherwise(F.regexp_replace(last, r"\.[^.]*$", ""))
    dot = F.regexp_extract(inner, r"\.([^.]*)$", 1)
    return F.coalesce(*(F.when(dot == x, t) for x, t in TYPES.items()), F.lit("unknown")), codec


def expand(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """A file is itself; a directory its files, not recursive and without Spark's own marks; a .txt file lists one path a
    line. Paths are of any file system that Spark knows. kind: the type of files whose names do not tell it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def status(p: str):
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            raise ValueError(f"no such file: {p}")
        return fs, fs.getFileStatus(at)

    fs, own = status(path)
    if own.isDirectory():
        inner = [s for s in fs.listStatus(own.getPath()) if s.isFile()]
        found = sorted(str(s.getPath()) for s in inner if s.getPath().getName()[0] not in "._")
    elif path.endswith(".txt") and kind is None:
        found = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]
        for p in found:
            status(p)
    else:
        found = [path]
    if not found:
        raise ValueError(f"no files in {path}")
    kinds = {kind or file_kind(p)[0] for p in found}
    if "unknown" in kinds or len(kinds) > 1:
        raise ValueError(f"files of unknown or different types: {sorted(kinds)}")
    return found


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def _read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files that Spark may split take two passes, others one."""
    conf = spark._jsparkSession.sessionState().conf()
    least = min(int(conf.filesMaxPartitionBytes()), int(conf.filesOpenCostInBytes()))  # no split of a file is smaller
    may = [p for p in paths if file_kind(p)[1] != "gzip" and _size(spark, p) > least]
    whole = [p for p in paths if p not in set(may)]
    parts = ([fastq.read_whole(spark, whole)] if whole else []) + ([fastq.read_split(fastq.split_lines(spark, may))] if may else [])
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def read_sequences(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, seq): one row a read, headers and qualities dropped. kind (fasta, fastq, lines) overrides what names tell."""
    paths = expand(spark, path, kind)
    kind = kind or file_kind(paths[0])[0]
    blocked = _blocked(spark, paths)
    if blocked:
        rest = [p for p in paths if p not in blocked]
        found = blocks.read_blocked(spark, blocked, kind)
        return found.union(_read(spark, rest, kind)) if rest else found
    return _read(spark, paths, kind)


def _blocked(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """The gzip files that tell their members' sizes, with their own; only of file systems that tasks can open themselves."""
    out = {}
    for p in paths:
        if file_kind(p)[1] == "gzip" and ranges.can_open(p) and blocks.is_blocked(p):
            out[p] = _size(spark, p)
    return out


def _read(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    if kind == "fastq":
        return _read_fastq(spark, paths)
    if kind == "lines":
        return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.col("value"), F.lit("\r")).alias("seq"))
    return _fasta_records(spark, paths)


def _fasta_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    source = F.col("_metadata.file_path").alias("path")
    records = spark.read.option("lineSep", "\n>").text(paths).select(source, F.col("value"), F.instr("value", "\n").alias("cut"))
    # The rest of the record's first line is its header.
    body = F.when(F.col("cut") > 0, F.substr("value", F.col("cut") + 1)).otherwise("")
    return records.where(F.length("value") > 0).select("path", F.translate(body, "\r\n", "").alias("seq"))


def read_for_counting(spark: SparkSession, path: str, k: int, kind: str | None = None) -> DataFrame:
    """(path, seq): reads, or parts of them; every window of k bases of a read is in exactly one row. Plain FASTA files are
    read by byte ranges, so a record may be of any length; all else is as in read_sequences()."""
    paths = expand(spark, path, kind)
    if (kind or file_kind(paths[0])[0]) != "fasta":
        return read_sequences(spark, path, kind)
    sizes = {p: _size(spark, p) for p in paths if file_kind(p)[1] == "none"}
    packed = [p for p in paths if p not in sizes]
    parts = ([ranges.read_pieces(spark, sizes, k)] if sizes else []) + ([_fasta_records(spark, packed)] if packed else [])
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
