"""Plain FASTA files by byte ranges, for counting: a record may be longer than a task's memory, and so may a line.

A range begins anywhere, in a header or in bases. What it begins in is what the last line before it is, so a first pass
finds for every range whether a line begins in it and of which kind the last such line is, and the last known kind is
carried over ranges without a line's beginning by a window. Every window of k bases belongs to the range in which it starts:
a range reads on into the next ones until it has k - 1 bases more or the record ends.

Files are opened by pyarrow's file systems, from paths or URIs that they know.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE, BLOCK = 32 << 20, 1 << 20


@cache
def _store(scheme: str):
    from pyarrow import fs

    return fs.LocalFileSystem() if not scheme else fs.FileSystem.from_uri(scheme)[0]


def located(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return _store(""), path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (_store(""), path)


def can_open(path: str) -> bool:
    """Whether pyarrow knows the path's file system; others are Spark's alone."""
    try:
        located(path)
    except pa.ArrowInvalid:
        return False
    return True


def opened(path: str) -> pa.NativeFile:
    store, at = located(path)
    return store.open_input_file(at)


def _read_at(file: pa.NativeFile, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def last_kind(file: pa.NativeFile, start: int, end: int, block: int = BLOCK) -> bool | None:
    """Whether the bytes from `end` on, to their line's end, are a header; None if no line begins in start + 1 .. end."""
    after, at = _read_at(file, end, 1), end
    while at > start:
        begin = max(start, at - block)
        data = _read_at(file, begin, at - begin) + after
        newline = data.rfind(b"\n", 0, at - begin)
        if newline >= 0:
            return data[newline + 1 : newline + 2] == b">"
        after, at = data[:1], begin
    return None


def _until_header(data: bytes, begins: bool) -> tuple[bytes, bool]:
    """(the bytes before a header line, whether one follows). begins: the data begins a line."""
    if begins and data[:1] == b">":
        return b"", True
    cut = data.find(b"\n>")
    return (data, False) if cut < 0 else (data[: cut + 1], True)


def bases_of(file: pa.NativeFile, start: int, end: int, header: bool, k: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bases in start .. end in pieces of about `block`: each is followed by the k - 1 bases after it in its record, so
    that every window of k that starts in the range is in exactly one piece. header: the range begins in a header line."""
    held, begins = b"", False
    for at in range(start, end, block):
        data = _read_at(file, at, min(block, end - at))
        while data:
            if header:
                cut = data.find(b"\n")
                data = data[cut + 1 :] if cut >= 0 else b""
                header, begins = cut < 0, cut >= 0
                continue
            own, header = _until_header(data, begins)
            held += own.translate(None, b"\r\n")
            begins, data = (own.endswith(b"\n") if own else begins), data[len(own) :]
            if header:
                if held:
                    yield held
                held = b""
        if len(held) >= block + k:
            yield held
            held = held[len(held) - k + 1 :]
    more, at = b"", end
    while held and not header and len(more) < k - 1 and (data := _read_at(file, at, max(4096, 2 * k))):
        own, header = _until_header(data, begins)
        more += own.translate(None, b"\r\n")
        begins, at = own.endswith(b"\n") if own else begins, at + len(data)
    if held:
        yield held + more[: k - 1]


def read_pieces(spark: SparkSession, sizes: dict[str, int], k: int, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(path, seq): pieces of the records of plain FASTA files ({path: bytes}); every window of k bases of a record is in
    exactly one piece. The first line of a file is a header whatever it says; lines end in \\n or \\r\\n. No piece is
    longer than a block and k bases, no task holds more than a few blocks."""
    n = min(100_000, max(1, sum(-(-x // size) for x in sizes.values())))
    files = spark.createDataFrame([x for x in sizes.items() if x[1]], "path string, bytes bigint")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(size).cast("bigint"))).alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "bytes").alias("end"))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    found.append(last_kind(file, r["start"], r["end"], block))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*batch.schema.names, "kind"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    for piece in bases_of(file, r["start"], r["end"], r["header"], k, block):
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([piece.decode("latin-1")])], names=["path", "seq"])

    told = ranges.repartition(n).mapInArrow(kinds, 'path string, start bigint, `end` bigint, kind boolean')
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    header = F.coalesce(F.last("kind", ignorenulls=True).over(before), F.lit(True))
    return told.select("path", "start", "end", header.alias("header")).repartition(n).mapInArrow(pieces, "path string, seq string")
