"""Minimizer ranks, bins and super-mers.

The table of 4^m m-mers (at most 262,144 rows) is bounded by the parameter range, so it is broadcast. Bins come from a
rolling minimum over Arrow buffers: nothing is shuffled until super-mers or their counts are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold.functions import bases
from strandfold.operators.bundles import BUNDLE, Tally, bundled, by_part, fours, hash_parts, layout, least_of, stretches
from strandfold.operators.kmers import buffers, dealt, pieces, strand_codes, tallied, valid_windows, window_words, words_of


def rank_table(spark: SparkSession, m: int, bins: int) -> DataFrame:
    """(mmer, allowed, rnk, bin): allowed m-mers first, each group by code; bins by the pyramid law over ranks."""
    if not 5 <= m <= 9:
        raise ValueError("m is from 5 to 9")
    total = 4**m
    mmer = bases.from_code(F.col("id"), m)
    every = spark.range(total).select(F.col("id").alias("code"), mmer.alias("mmer"))
    fine = (
        (F.col("mmer") <= bases.reverse_complement(F.col("mmer")))
        & ~F.col("mmer").isin("AA" + "G" * (m - 2), "AA" + "C" * (m - 2))
        & (F.instr(F.substring("mmer", 2, m), "AA") == 0)
        & ~F.col("mmer").startswith("ACA")
    )
    ranked = every.withColumn("allowed", fine).withColumn("rnk", F.row_number().over(Window.orderBy(~F.col("allowed"), "code")).cast("bigint") - 1)
    b = 2 * bins
    whole = total - total % b
    p = whole // b
    q = F.expr(f"pmod(rnk + ((rnk div {b}) * {b}) div {max(p, 1)}, {b})")
    x = q - bins
    pyramid = F.when(F.col("rnk") < whole, F.when(x < 0, -x - 1).otherwise(x)).otherwise(bins - 1 - F.col("rnk") % bins)
    return ranked.select("mmer", "allowed", "rnk", pyramid.cast("bigint").alias("bin"))


def _bin_tables(spark: SparkSession, m: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each m-mer's code, bin of each rank)."""
    table = rank_table(spark, m, bins).select(bases.packed_code(F.col("mmer")).alias("code"), "rnk", "bin").toPandas()
    rank_of, bin_of = np.empty(4**m, np.int32), np.empty(4**m, np.int32)
    rank_of[table["code"]], bin_of[table["rnk"]] = table["rnk"], table["bin"]
    return rank_of, bin_of


def _window_bins(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray], k: int, m: int, canonical: bool) -> np.ndarray:
    """The bin of every window of k bytes; what it says of windows that are not all bases has no meaning."""
    rank_of, bin_of = tables
    forward, reverse = strand_codes(data, {m})[m]
    return bin_of[least_of(rank_of[np.minimum(forward, reverse) if canonical else forward], k - m + 1)]


def _stretches(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(first window, bases, windows) of maximal stretches of consecutive windows `starts` with one owner."""
    first = starts[np.append(True, (np.diff(starts) != 1) | (np.diff(owner[starts]) != 0))]
    n = np.diff(np.append(np.searchsorted(starts, first), len(starts)))
    sizes = n + k - 1
    ends = np.cumsum(sizes)
    upper = np.where(data >= 97, data - 32, data)
    text = upper[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
    made = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(text))
    return first, made.cast(pa.string()), n


def supermers(reads: DataFrame, k: int, m: int, bins: int, canonical: bool = True, seq: str = "seq", most: int = 1 << 20) -> DataFrame:
    """(bin, seq, n_kmers): maximal stretches of consecutive k-mers of one bin, as in staging. Their number is this
    engine's own; the k-mers they hold are not. A k-mer's bin is that of the m-mer of lowest rank in it."""
    shared = reads.sparkSession.sparkContext.broadcast(_bin_tables(reads.sparkSession, m, bins))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in pieces(*buffers(batch.column(0)), k, most):
                starts = np.flatnonzero(valid_windows(data, offsets, k))
                if len(starts):
                    at = _window_bins(data, shared.value, k, m, canonical)
                    first, made, n = _stretches(data, starts, at, k)
                    yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int64)), made, pa.array(n.astype(np.int64))], names=["bin", "seq", "n_kmers"])

    return dealt(reads.select(seq)).mapInArrow(work, "bin bigint, seq string, n_kmers bigint")


#: Parts of a part that is too large; levels beyond the longest minimizer go by the k-mer itself.
FAN, LONGEST, BY_KMER = 64, 9, 3
_TAG = 50


def part_bin(part: np.ndarray) -> np.ndarray:
    """The bin that a part belongs to: a part is its level in the upper bits and a path of digits that begins with the bin."""
    return (part & ((1 << _TAG) - 1)) // FAN ** (part >> _TAG)


def pieces_of(part: int) -> list[int]:
    """The parts of a part, one level on."""
    level, path = part >> _TAG, part & ((1 << _TAG) - 1)
    return [path * FAN + digit | (level + 1) << _TAG for digit in range(FAN)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)


class Parts:
    """The rule that files a k-mer under a part: its bin, and where that is too large a digit more for each level, from the
    least hash of a longer minimizer, then from the hash of the k-mer. `over` lists the parts that are too large."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray], k: int, m: int, canonical: bool, over: list[int]) -> None:
        self.tables, self.k, self.m, self.canonical = tables, k, m, canonical
        self.over = np.array(sorted(over), np.int64)
        self.by_minimizer = max(0, min(LONGEST, k) - m)

    @property
    def levels(self) -> int:
        return self.by_minimizer + BY_KMER

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the windows that are k-mers, part of every window, whether it goes by the k-mer)."""
        starts = np.flatnonzero(valid_windows(data, offsets, self.k))
        part = _window_bins(data, self.tables, self.k, self.m, self.canonical).astype(np.int64)
        alone = np.zeros(len(part), bool)
        hashes = None
        for level in range(1, self.levels + 1):
            if not len(self.over):
                break
            own = starts[np.isin(part[starts], self.over[self.over >> _TAG == level - 1])]
            if not len(own):
                continue
            if level <= self.by_minimizer:
                m = self.m + level
                forward, reverse = strand_codes(data, {m})[m]
                least = least_of(_mix(np.minimum(forward, reverse) if self.canonical else forward).astype(np.int64), self.k - m + 1)
                digit = _mix(least[own]) % np.uint64(FAN)
            else:
                if hashes is None:
                    h = np.zeros(len(starts), np.uint64)
                    for w in window_words(data, offsets, self.k, self.canonical):
                        h = _mix(w.view(np.uint64) ^ h)
                    hashes = np.zeros(len(part), np.uint64)
                    hashes[starts] = h
                digit = (hashes[own] >> np.uint64(6 * (level - self.by_minimizer))) % np.uint64(FAN)
                alone[own] = True
            path = (part[own] & ((1 << _TAG) - 1)) * FAN + digit.astype(np.int64)
            part[own] = path | level << _TAG
        return starts, part, alone


def part_sizes(reads: DataFrame, parts: Parts, seq: str = "seq", most: int = 1 << 20) -> DataFrame:
    """(part, n): the k-mers that each part would get; of those that go by the k-mer, a batch counts each once."""
    shared = reads.sparkSession.sparkContext.broadcast(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            for data, offsets in pieces(*buffers(batch.column(0)), parts.k, most):
                if len(data) < parts.k:
                    continue
                starts, part, alone = parts.of(data, offsets)
                if not len(parts.over):
                    n = np.bincount(part[starts])
                    own = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["part", "n"])
                    continue
                single = alone[starts]
                found = [part[starts[~single]]]
                if single.any():
                    words = [w[single] for w in window_words(data, offsets, parts.k, False)]
                    found.append(tallied([part[starts[single]], *words])[0][0])
                own, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], names=["part", "n"])

    return dealt(reads.select(seq)).mapInArrow(work, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))


#: Bits of a sub-part at most, so that a part and its sub-part are one number of 63 bits.
SUB = 9


def part_supermers(reads: DataFrame, parts: Parts, slots: dict[int, int], bits: int = 0, seq: str = "seq", most: int = 1 << 20) -> DataFrame:
    """(bin, part, sub, slot, bundle): for each piece of input and part its super-mers; k-mers of parts that go by the k-mer stand
    alone, once a piece, in one bundle for each number of copies. slots: of each part; bits: of the sub-parts that a part is
    dealt to by hash, to be counted one after the other."""
    known = np.array(sorted(slots), np.int64)
    shared = reads.sparkSession.sparkContext.broadcast((parts, known, np.array([slots[p] for p in known.tolist()], np.int64)))

    def rows(slot: np.ndarray, key: np.ndarray, copies: np.ndarray, n: np.ndarray, smers: np.ndarray, lengths: pa.Array, packed: pa.Array) -> pa.RecordBatch:
        part, sub = key >> SUB, key & ((1 << SUB) - 1)
        columns = [*map(pa.array, (part_bin(part), part, sub, slot[np.searchsorted(known, part)], n, smers, copies)), lengths, packed]
        return pa.RecordBatch.from_arrays(columns, names=["bin", "part", "sub", "slot", *BUNDLE])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, slot = shared.value
        k = parts.k
        for batch in batches:
            for data, offsets in pieces(*buffers(batch.column(0)), k, most):
                if len(data) < k:
                    continue
                starts, part, alone = parts.of(data, offsets)
                key_of = part << SUB | hash_parts(data, k, parts.canonical, bits) if bits else part << SUB
                quads, single = fours(data), starts[alone[starts]]
                together = np.zeros(len(part), bool)
                together[starts] = ~alone[starts]
                first, n = stretches(together, key_of)
                if len(first):
                    key, *told = bundled(quads, first, n, key_of[first], k)
                    yield rows(slot, key, np.ones(len(key), np.int64), *told)
                if len(single):
                    # Both strands apart, so that plain counting can be had from canonical parts.
                    key = [key_of[single], *(w[alone[starts]] for w in window_words(data, offsets, k, False))]
                    order = np.lexsort(key)
                    new = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in key]))
                    places, copies = single[order][new], np.diff(np.append(np.flatnonzero(new), len(order)))
                    order = np.lexsort([copies, key_of[places]])
                    places, copies = places[order], copies[order]
                    new = np.append(True, (np.diff(key_of[places]) != 0) | (np.diff(copies) != 0))
                    _, *told = bundled(quads, places, np.ones(len(places), np.int64), np.cumsum(new), k)
                    yield rows(slot, key_of[places[new]], copies[new], *told)

    return dealt(reads.select(seq)).mapInArrow(work, "bin bigint, part bigint, sub bigint, slot bigint, n_kmers bigint, smers bigint, copies bigint, lengths binary, bases binary")


def distinct_per_bin(reads: DataFrame, k: int, m: int, bins: int, canonical: bool = True) -> DataFrame:
    """(bin, kmers, ukmers) of the bins in use. A bin is dealt to several tasks; only numbers leave them."""
    bits = min(layout(reads)[0], 30 - bins.bit_length())
    shared = reads.sparkSession.sparkContext.broadcast(_bin_tables(reads.sparkSession, m, bins))

    def parts(data: np.ndarray) -> np.ndarray:
        return _window_bins(data, shared.value, k, m, canonical) << bits | hash_parts(data, k, canonical, bits)

    def numbers(tally: Tally, own: int) -> Iterator[pa.RecordBatch]:
        for _, n in tally.done():
            yield pa.RecordBatch.from_pylist([{"bin": own, "kmers": int(n.sum()), "ukmers": len(n)}])

    counted = by_part(reads, k, canonical, parts, numbers, "bin bigint, kmers bigint, ukmers bigint", apart=bits)
    return counted.groupBy("bin").agg(F.sum("kmers").alias("kmers"), F.sum("ukmers").alias("ukmers"))


def bin_stats(staged: DataFrame, bins: int) -> DataFrame:
    """(bin, kmers) of super-mers, one row for each of the `bins` bins, empty ones too."""
    found = staged.groupBy("bin").agg(F.sum("n_kmers").alias("n"))
    return staged.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("kmers"))


def bin_order(stats: DataFrame, bins: int) -> DataFrame:
    """(bin, kmers, ord): ascending by k-mers, but the first quarter of the bins descending, ties by bin."""
    small = Window.orderBy("kmers", "bin")  # at most 4096 rows
    ranked = stats.withColumn("r", F.row_number().over(small).cast("bigint"))
    quarter = bins // 4
    return ranked.select("bin", "kmers", F.when(F.col("r") <= quarter, quarter + 1 - F.col("r")).otherwise(F.col("r")).cast("bigint").alias("ord"))


def bin_size_stats(stats: DataFrame) -> DataFrame:
    """One row of figures over the bins' k-mer numbers."""
    return stats.agg(F.count("*").alias("n_bins"), F.min("kmers").alias("min_kmers"), F.max("kmers").alias("max_kmers"), F.round(F.avg("kmers"), 6).alias("avg_kmers"), F.round(F.stddev_samp("kmers"), 4).alias("sd_kmers"), F.sum("kmers").alias("sum_kmers"))
