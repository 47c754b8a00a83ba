"""k-mer enumeration and exact counting.

Two forms give the same rows: `enumerate_kmers` + `count_kmers` stay in SQL expressions for any k; `count_packed` slides
over Arrow buffers with numpy and groups 8-byte words of 31 bases (one word to k = 31, five to k = 135): below 15 bases
counted within a batch before anything is shuffled, else from bundles of super-mers (bundles.py). Long reads are cut with
an overlap of k - 1 bases, so that no window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions import bases

#: Bases of one 64-bit word; the sign bit stays free. Shorter k-mers than BUNDLED are so few that a batch sums most of them.
WORD, BUNDLED = 31, 15


@dataclass(frozen=True)
class KmerConfig:
    """Parameters with their ranges; m=None derives the minimizer length from the number of bins."""

    k: int = 28
    min_count: int = 3
    canonical: bool = True
    bins: int = 512
    m: int | None = None
    widest: int = 135

    def __post_init__(self) -> None:
        for name, value, low, high in (("k", self.k, 8, self.widest), ("min_count", self.min_count, 1, 1 << 30), ("bins", self.bins, 2, 4096), ("m", self.minimizer, 5, min(9, self.k))):
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is not in {low}..{high}")
        if 4 * 4**self.minimizer < self.bins:
            raise ValueError("bins exceed what minimizers of this length can fill")

    @property
    def minimizer(self) -> int:
        return auto_minimizer(self.bins) if self.m is None else self.m


def auto_minimizer(bins: int) -> int:
    """The number of base-4 digits of `bins`, then up to two more, within 5 and 9."""
    m = 0
    while bins:
        bins >>= 2
        m += 1
    for _ in range(2):
        m += m < 9
    return max(5, m)


def minimizer_length(bins: Column) -> Column:
    """auto_minimizer() of a column: a number of n binary digits has (n + 1) div 2 base-4 digits."""
    digits = F.floor((F.length(F.bin(bins)) + 1) / 2).cast("int")
    return F.greatest(F.least(digits + 2, F.greatest(digits, F.lit(9))), F.lit(5))


def scanned_bytes(df: DataFrame) -> int:
    """Bytes that the plan's leaves scan, by the plan's own figures; nothing is run to find them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out if the scanned files are smaller than one split for each core: enumeration multiplies rows later.

    What is moved is thereby less than cores times maxPartitionBytes, whatever the cluster; sizes come from the plan, so
    nothing is run to find them.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(2 * cores) if scanned_bytes(df) < cores * split else df


def cut_reads(reads: DataFrame, k: int, most: int = 1 << 16, seq: str = "seq") -> DataFrame:
    """Reads longer than `most` as pieces that overlap by k - 1 characters: every window of k is in exactly one piece."""
    kept = [c for c in reads.columns if c != seq]
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - k, F.lit(0)), F.lit(most))
    return reads.where(F.col(seq).isNotNull()).select(*kept, seq, F.explode(starts).alias("_at")).select(*kept, F.substr(F.col(seq), F.col("_at") + 1, F.lit(most + k - 1)).alias(seq))


def split_runs(reads: DataFrame, k: int = 1, seq: str = "seq") -> DataFrame:
    """(other columns, run): runs of bases of at least k; shorter ones are dropped before anything is multiplied."""
    kept = [c for c in reads.columns if c != seq]
    return reads.select(*kept, F.explode(F.filter(bases.runs(F.col(seq)), lambda r: F.length(r) >= k)).alias("run"))


def enumerate_kmers(runs: DataFrame, k: int, canonical: bool = True, most: int = 1024) -> DataFrame:
    """(other columns, pos, kmer): all windows of k bases; canonical: the smaller of a window and its reverse complement.

    A run is cut into overlapping pieces first, for substring() walks from the start of what it is given.
    """
    kept = [c for c in runs.columns if c != "run"]
    cut = runs.where(F.length("run") >= k).select(*kept, "run", F.explode(F.sequence(F.lit(0), F.length("run") - k, F.lit(most))).alias("at"))
    piece = cut.select(*kept, "at", F.substr(F.col("run"), F.col("at") + 1, F.lit(most + k - 1)).alias("run")).withColumn("rc", bases.reverse_complement(F.col("run")))
    one = piece.select(*kept, "at", "run", "rc", F.explode(F.sequence(F.lit(1), F.length("run") - k + 1)).alias("i"))
    forward = F.substring("run", F.col("i"), F.lit(k))
    kmer = F.least(forward, F.substring("rc", F.length("run") - k + 2 - F.col("i"), F.lit(k))) if canonical else forward
    return one.select(*kept, (F.col("at") + F.col("i")).alias("pos"), kmer.alias("kmer"))


def count_kmers(reads: DataFrame, k: int, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(kmer, cnt) of all distinct k-mers."""
    kmers = enumerate_kmers(split_runs(cut_reads(dealt(reads.select(seq)), k, seq=seq), k, seq), k, canonical)
    return kmers.groupBy("kmer").agg(F.count("*").alias("cnt"))


def at_least(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.where(F.col("cnt") >= min_count)


_CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(bases.BASES):
    _CODES[ord(_b)] = _CODES[ord(_b.lower())] = _i


def valid_windows(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k bytes hold only bases of one text."""
    n = len(data)
    bad = np.concatenate([[0], np.cumsum(_CODES[data] > 3)])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return (bad[k:] == bad[:-k]) & (ends[: n - k + 1] - np.arange(n - k + 1) >= k)


def strand_codes(data: np.ndarray, widths: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width (at most 31) the codes of all windows and of their reverse complements, from windows that double."""
    codes = (_CODES[data] & 3).astype(np.int64)
    unit_f, unit_r, width = codes, 3 - codes, 1
    out: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    while True:
        for want in widths:
            if want & width:
                if want not in out:
                    out[want] = unit_f, unit_r, width
                else:
                    f, r, done = out[want]
                    size = min(len(f), len(unit_f) - done)
                    out[want] = (f[:size] << 2 * width) | unit_f[done : done + size], r[:size] | (unit_r[done : done + size] << 2 * done), done + width
        if 2 * width > max(widths):
            return {w: (f[: len(data) - w + 1], r[: len(data) - w + 1]) for w, (f, r, _) in out.items()}
        size = len(unit_f) - width
        unit_f, unit_r = (unit_f[:size] << 2 * width) | unit_f[width:], unit_r[:size] | (unit_r[width:] << 2 * width)
        width *= 2


def window_words(data: np.ndarray, offsets: np.ndarray, k: int, canonical: bool) -> list[np.ndarray]:
    """The words, 31 bases each and the rest, of every window of k bases that lies in one text."""
    places = list(range(0, k, WORD))
    if len(data) < k:
        return [np.zeros(0, np.int64)] * len(places)
    at = np.flatnonzero(valid_windows(data, offsets, k))
    last = k - places[-1]
    codes = strand_codes(data, {last, min(WORD, k)})
    width = [min(WORD, k - p) for p in places]
    forward = [codes[w][0][at + p] for w, p in zip(width, places, strict=True)]
    if not canonical:
        return forward
    reverse = [codes[w][1][at + k - p - w] for w, p in zip(width, places, strict=True)]
    swap, same = np.zeros(len(at), bool), np.ones(len(at), bool)
    for f, r in zip(forward, reverse, strict=True):
        swap |= same & (r < f)
        same &= r == f
    return [np.where(swap, r, f) for f, r in zip(forward, reverse, strict=True)]


def window_codes(data: np.ndarray, offsets: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """Packed codes of every window of k bases (at most 31) that lies in one text."""
    return window_words(data, offsets, k, canonical)[0]


def tallied(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(words, counts) of equal rows of words. Rows may stay apart if hashes of several words collide; sums come later."""
    if len(words) == 1:
        found, n = np.unique(words[0], return_counts=True)
        return [found], n
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h)
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    first = np.flatnonzero(new)
    return [w[first] for w in words], np.diff(np.append(first, len(order)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy of the bytes; nulls are empty."""
    col = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    if not len(col) or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of `most` window starts at a time, wherever texts end; pieces overlap by k - 1 bytes."""
    for at in range(0, max(len(data) - k + 1, 0), most):
        end = min(len(data), at + most + k - 1)
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")]
        yield data[at:end], np.concatenate([[at], inner, [end]]) - at


def words_of(k: int) -> list[str]:
    """The word columns of packed k-mers: `code` to 31 bases, else w0, w1, ..."""
    return ["code"] if k <= WORD else [f"w{i}" for i in range(-(-k // WORD))]


def count_packed(reads: DataFrame, k: int, canonical: bool = True, seq: str = "seq", most: int = 1 << 20) -> DataFrame:
    """(words_of(k), cnt): BIGINT words of 31 bases and the rest. From BUNDLED bases on super-mers are moved, not k-mers."""
    if k >= BUNDLED:
        from strandfold.operators import bundles

        return bundles.count(reads, k, canonical, seq, most=most)
    names = words_of(k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in pieces(*buffers(batch.column(0)), k, most):
                words, n = tallied(window_words(data, offsets, k, canonical))
                yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(n.astype(np.int64))], names=[*names, "n"])

    schema = ", ".join(f"{c} bigint" for c in [*names, "n"])
    return dealt(reads.select(seq)).mapInArrow(work, schema).groupBy(*names).agg(F.sum("n").alias("cnt"))


def spelled(k: int) -> Column:
    """The k-mer of its word columns."""
    return F.concat(*(bases.from_code(F.col(c), min(WORD, k - i * WORD)) for i, c in enumerate(words_of(k))))


def count(reads: DataFrame, config: KmerConfig = KmerConfig(), seq: str = "seq", unfiltered: bool = False) -> DataFrame:
    """(kmer, cnt): the engine's default path, packed; k-mers are spelled out after the threshold."""
    least = 1 if unfiltered else config.min_count
    if config.k >= BUNDLED:
        from strandfold.operators import bundles

        return bundles.count(reads, config.k, config.canonical, seq, least, spell=True)
    counts = at_least(count_packed(reads, config.k, config.canonical, seq), least)
    return counts.select(spelled(config.k).alias("kmer"), "cnt")


def histogram(counts: DataFrame, size: int = 512) -> DataFrame:
    """(bucket, n_kmers), zero-filled: bucket 1 to size-1 for that count, 0 for all larger; counts before any threshold."""
    bucket: Column = F.when(F.col("cnt") < size, F.col("cnt")).otherwise(F.lit(0)).cast("bigint")
    found = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.sparkSession.range(size).withColumnRenamed("id", "bucket")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n_kmers"))


def histogram_lines(hist: DataFrame, size: int = 512) -> DataFrame:
    """(ord, line): the histogram as text lines, largest bucket last; numbers padded to three and nine places."""
    large = F.col("bucket") == 0
    at = F.when(large, size).otherwise(F.col("bucket"))
    line = F.concat(F.when(large, F.lit(">=")).otherwise(F.lit("  ")), F.format_string("%3d; %9d", at, "n_kmers"))
    head = hist.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("ord"), F.lit("counter; number of uk-mers").alias("line"))
    return head.union(hist.select(at.alias("ord"), line.alias("line")))


def write_histogram(hist: DataFrame, path: str, size: int = 512) -> None:
    """The histogram's lines in order as one text file of the folder `path`; size + 1 lines whatever the input."""
    histogram_lines(hist, size).orderBy("ord").coalesce(1).select("line").write.text(path)


def summary(counts: DataFrame, min_count: int) -> DataFrame:
    """One row: k-mers, distinct k-mers, distinct below the threshold."""
    zero = F.lit(0).cast("bigint")
    return counts.agg(F.coalesce(F.sum("cnt"), zero).alias("kmers"), F.count("*").alias("ukmers"), F.count_if(F.col("cnt") < min_count).alias("below_threshold"))


def base_totals(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row: reads, bases and k-mers of the input."""
    lengths = F.transform(bases.runs(F.col(seq)), F.length)
    per = dealt(reads.select(seq)).select(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("b"), F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(x - k + 1, F.lit(0))).alias("n"))
    return per.agg(F.count("*").alias("reads"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bases"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("kmers"))
