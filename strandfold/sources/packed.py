"""Packed counts as binary files: records of a count (one byte below 255, else FF and 32 bits little-endian) and the
packed k-mer, one after the other.

Writing follows a commit protocol: tasks write files of bounded size in a folder of their own job, and the driver moves
those of the tasks that succeeded under names that hold the job's id, so jobs that write to one folder, one after the other
or at once, keep each other's files. Records vary in length, so beside each file lies an index of the offsets of every
BLOCK-th record (`.index`, 64 bits each, little-endian), by which one file is read by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandfold.functions import bases
from strandfold.sources.ranges import located, opened

_QUADS = np.array([list((bases.BASES[b >> 6] + bases.BASES[b >> 4 & 3] + bases.BASES[b >> 2 & 3] + bases.BASES[b & 3]).encode()) for b in range(256)], np.uint8)
BLOCK, FILE_BYTES, TEMPORARY = 1 << 16, 256 << 20, "_temporary"


def _decoded(data: bytes, k: int, block: int = BLOCK, last: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(k-mers as rows of k letters, counts, bytes used so far) of packed records, at most `block` at a time.

    Stretches of short records are read as a matrix; a record with a long count ends a stretch. Bytes at the end that are no
    whole record are an error if the data is the last there is, else they are left.
    """
    data, width, at = np.frombuffer(data, np.uint8), -(-k // 4), 0
    while at < len(data):
        n = min(block, (len(data) - at) // (1 + width))
        rows = data[at : at + n * (1 + width)].reshape(n, 1 + width)
        long = np.flatnonzero(rows[:, 0] == 255)
        n = int(long[0]) if len(long) else n
        if n:
            letters, counts = _QUADS[rows[:n, 1:]].reshape(n, -1)[:, :k], rows[:n, 0].astype(np.int64)
            at += n * (1 + width)
        elif at + 5 + width <= len(data) and data[at] == 255:
            letters, counts = _QUADS[data[at + 5 : at + 5 + width]].reshape(1, -1)[:, :k], np.array([int.from_bytes(data[at + 1 : at + 5].tobytes(), "little")])
            at += 5 + width
        elif last:
            raise ValueError(f"{len(data) - at} bytes at the end are no whole record for k={k}")
        else:
            return
        yield letters, counts, at


def decoded(data: bytes, k: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k-mers as rows of k letters, counts) of packed records that are all there."""
    return ((letters, counts) for letters, counts, _ in _decoded(data, k, block))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own under _temporary/<job>; commit() moves those of the attempts that
    succeeded, then, on overwrite, deletes the files that were there before the job; abort() leaves the folder as it was."""

    def __init__(self, uri: str, overwrite: bool, file_bytes: int) -> None:
        self.uri, self.overwrite, self.file_bytes, self.job = uri.rstrip("/"), overwrite, file_bytes, uuid.uuid4().hex
        self.earlier = [x.path for x in self._files()] if overwrite else []

    def _files(self):
        from pyarrow import fs

        store, path = located(self.uri)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [x for x in found if x.is_file and x.path.endswith((".bin", ".index"))]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = located(self.uri)
        folder, part, attempt = f"{path}/{TEMPORARY}/{self.job}", TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(folder)
        made, out, size, n, offsets = [], None, 0, 0, []

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{made[-1]}.index") as index:
                index.write(np.array(offsets, "<u8").tobytes())

        for batch in iterator:
            col = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else [0]
            at = 0
            while at < len(col):
                if out is None:
                    made.append(f"{folder}/part-{part:05d}-{len(made):04d}-{attempt}")
                    out, size, n, offsets = store.open_output_stream(made[-1]), 0, 0, []
                # As many records as the file has room for, one at least.
                end = min(len(col), max(at + 1, int(np.searchsorted(ends, ends[at] + self.file_bytes - size, "right")) - 1))
                marked = np.arange(at + -n % BLOCK, end, BLOCK)
                offsets += (size + ends[marked] - ends[at]).tolist()
                out.write(memoryview(col.buffers()[2])[ends[at] : ends[end]])
                size, n, at = size + int(ends[end] - ends[at]), n + end - at, end
                if size >= self.file_bytes or at < len(col):
                    close()
                    out = None
        if out is not None:
            close()
        return _Written(made)

    def commit(self, messages: list) -> None:
        store, path = located(self.uri)
        store.create_dir(path)
        for made in (f for m in messages if m is not None for f in m.files):
            # part-<task>-<file>-<attempt>: the attempt's id gives way to the job's.
            final = f"{path}/{made.rpartition('/')[2].rpartition('-')[0]}-{self.job}.bin"
            store.move(f"{made}.index", f"{final}.index")
            store.move(made, final)
        for old in self.earlier:
            store.delete_file(old)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete the job's own folder, and the common one if no other job has one in it."""
        from pyarrow import fs

        store, path = located(self.uri)
        if store.get_file_info(f"{path}/{TEMPORARY}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{TEMPORARY}/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{path}/{TEMPORARY}", allow_not_found=True)):
            if store.get_file_info(f"{path}/{TEMPORARY}").type == fs.FileType.Directory:
                store.delete_dir(f"{path}/{TEMPORARY}")


class PackedSink(DataSource):
    """format("packed").save(folder) of one BINARY column: the records as they are, nothing between or after them. Modes
    append and overwrite; option fileBytes: the size that a file does not exceed unless one record does."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, int(self.options.get("fileBytes", FILE_BYTES)))


def records(counts: DataFrame, k: int) -> DataFrame:
    """(record BINARY) of (kmer, cnt)."""
    return counts.select(F.unhex(bases.record_hex(F.col("cnt"), F.col("kmer"), k)).alias("record"))


def write_packed(counts: DataFrame, path: str, k: int, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    """Packed files in the folder `path`: any URI that pyarrow's file systems open, as tasks write it themselves. Counts
    beyond 32 bits are written as the largest number that the format has."""
    counts.sparkSession.dataSource.register(PackedSink)
    records(counts, k).write.format("packed").option("fileBytes", file_bytes).mode(mode).save(path)


def _packed_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the `.bin` files of a folder, or of those that a pattern in the last part matches."""
    from fnmatch import fnmatch

    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    if info.is_file:
        return [(path, info.size)]
    folder, pattern = (at, "*.bin") if info.type == fs.FileType.Directory else (at.rpartition("/")[0], at.rpartition("/")[2])
    root = path.rstrip("/") if info.type == fs.FileType.Directory else path.rpartition("/")[0]
    return sorted((f"{root}/{x.base_name}", x.size) for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and fnmatch(x.base_name, pattern))


def read_packed(spark: SparkSession, path: str, k: int, part_bytes: int = 32 << 20, block: int = 4 << 20) -> DataFrame:
    """(kmer, cnt) of packed files. Files with an index beside them are read in parts of about `part_bytes`, others as a
    whole; either way a block at a time, whatever the file's size, in at most four tasks a core or one for each 32 MB."""
    files = _packed_files(path)
    if not files:
        return spark.createDataFrame([], "kmer string, cnt bigint")
    # Tasks follow the bytes, not the files or parts, which may be small: a task reads many of those.
    most = max(4 * spark.sparkContext.defaultParallelism, sum(size for _, size in files) >> 25)
    n = min(most, sum(-(-size // part_bytes) for _, size in files) + 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            store, at = located(f"{r['path']}.index")
            marks = np.zeros(0, "<u8")
            if store.get_file_info(at).is_file:
                with store.open_input_file(at) as file:
                    marks = np.frombuffer(file.read(), "<u8")
            # The first marked record at or after each multiple of part_bytes.
            cuts = marks[np.minimum(np.searchsorted(marks, np.arange(part_bytes, r["size"], part_bytes)), len(marks) - 1)] if len(marks) else []
            edges = np.unique(np.array([0, *cuts, r["size"]], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * (len(edges) - 1), pa.string()), pa.array(edges[:-1]), pa.array(edges[1:])], names=["path", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            with opened(r["path"]) as file:
                at, rest = r["start"], b""
                file.seek(at)
                while at < r["end"]:
                    data = rest + file.read(min(block, r["end"] - at))
                    at, used = at + len(data) - len(rest), 0
                    for letters, counts, used in _decoded(data, k, last=at >= r["end"]):
                        ends = np.arange(0, letters.size + 1, k, dtype=np.int32)
                        made = pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))
                        yield pa.RecordBatch.from_arrays([made, pa.array(counts)], names=["kmer", "cnt"])
                    rest = data[used:]

    found = spark.createDataFrame(files, "path string, size bigint").repartition(min(most, len(files)))
    return found.mapInArrow(parts, "path string, start bigint, `end` bigint").repartition(n).mapInArrow(work, "kmer string, cnt bigint")


def fasta_lines(counts: DataFrame) -> DataFrame:
    """(line): `>count`, newline, k-mer."""
    return counts.select(F.concat(F.lit(">"), F.col("cnt").cast("string"), F.lit("\n"), F.col("kmer")).alias("line"))


def write_fasta(counts: DataFrame, path: str) -> None:
    fasta_lines(counts).write.text(path)


def packed_to_fasta(spark: SparkSession, packed: str, k: int, out: str) -> None:
    """Packed files as FASTA text."""
    write_fasta(read_packed(spark, packed, k), out)
