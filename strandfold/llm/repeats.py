"""Removal of repeated byte strings: every byte covered by a `size`-byte string that also starts anywhere else.

Equal windows must meet in one shard, and no shard may see the whole corpus. A window of `size` bytes is filed under its
minimizer, the gram of GRAM bytes with the smallest hash in it; consecutive windows with one minimizer form a run of at
most size - GRAM + 1 windows. Runs whose gram stands nowhere else are done. Equal runs are repeated as a whole and enter
the sort once. The bytes of one run of each content go to their gram's shard, where external induced sorting of all
suffixes, with the prefixes that neighbours share, finds the repeated windows (induced.py).

What moves between tasks is two hashes and a digest a run, about size / 3 bytes apart, and the bytes of runs whose gram has several
contents. Runs that repeat within a task are settled there and go on once. A gram with many contents is split further, by
classes of `step` neighbouring window places and the bytes that all windows of a class share.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm import induced
from strandfold.llm.common import fresh, spread, text_slices, written
from strandfold.llm.decontaminate import _mixed, _powers

GRAM = 64


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte times power, and the inverse powers: a string's hash is (sums[b] - sums[a]) * back[a]."""
    powers, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums, back


#: Places of a text in 32 bits: grams are ordered by the other half of their hash, in texts of any length alike.
PLACES = np.uint64(32)


def digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b of each stretch of bytes, 128 bits: as keys they stand for the bytes, also of texts made to collide."""
    bytes_ = memoryview(np.ascontiguousarray(data)).cast("B")
    made = b"".join([blake2b(bytes_[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, "S16")


def runs_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, gram's place, gram hash, digest of all bytes) of the runs of windows with one minimizer."""
    n, w = len(data), size - GRAM + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = ends - np.arange(n) >= size
    if n < size or not valid.any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64), np.zeros(0, "S16"))
    sums, back = _sums(data)
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    # Order by the hash's upper bits, then by place: the leftmost smallest gram of each window in one number.
    keyed = (grams >> PLACES << PLACES) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keyed) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(keyed) - w + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    at = (least & ((np.uint64(1) << PLACES) - np.uint64(1))).astype(np.int64)
    p = np.flatnonzero(valid[:windows])
    new = np.append(True, (np.diff(at[p]) != 0) | (np.diff(p) != 1))
    first = p[new]
    last = p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]
    return np.searchsorted(offsets, first, "right") - 1, first, last, at[first], grams[at[first]], digests(data, first, last + size)


class _Seen:
    """Contents that a task has met more than once; bounded, for it only saves work."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.known, self.most = np.zeros(0, "S16"), most

    def settled(self, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(goes on, repeated here) of each content: the first of its kind goes on, unless one went on before."""
        kinds, first, which, n = np.unique(contents, return_index=True, return_inverse=True, return_counts=True)
        old = np.isin(kinds, self.known, assume_unique=True)
        on = np.zeros(len(contents), bool)
        on[first[~old]] = True
        again = (n > 1) | old
        fresh_ones = kinds[again & ~old]
        self.known = np.concatenate([self.known, fresh_ones])[-self.most :]
        return on, again[which]


_RUN = "h bigint, h2 int, first int, last int, at int, gram bigint, content binary, sent boolean, repeated boolean"


def _fixed(content: np.ndarray) -> pa.Array:
    ends = np.arange(0, 16 * (len(content) + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(content), [None, pa.py_buffer(ends), pa.py_buffer(content.tobytes())])


def _find_runs(texts: DataFrame, size: int) -> DataFrame:
    """All runs of the texts (h, h2, text): windows first to last, the gram's place, hashes; whether the run is sent on,
    and whether it is known to be repeated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            h, h2 = batch.column("h").to_numpy(), batch.column("h2").to_numpy()
            for i, _, data, offsets in text_slices(batch, "text", 1 << 20):
                text, first, last, at, gram, content = runs_of(data, offsets, size)
                start = offsets[text]
                places = [pa.array((x - start).astype(np.int32)) for x in (first, last, at)]
                sent, repeated = seen.settled(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i + text]), pa.array(h2[i + text]), *places, pa.array(gram.view(np.int64)), _fixed(content), pa.array(sent), pa.array(repeated)],
                    names=["h", "h2", "first", "last", "at", "gram", "content", "sent", "repeated"],
                )

    return texts.mapInArrow(work, _RUN)


class _Shard:
    """Pieces as one text of symbols, in a file beyond induced.IN_MEMORY, and what tells where each came from."""

    def __init__(self) -> None:
        self.file, self.size = tempfile.SpooledTemporaryFile(induced.IN_MEMORY), 0
        self.own: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: pa.RecordBatch) -> None:
        col = rows.column("bytes").cast(pa.large_binary())
        ends = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
        sizes = np.diff(ends)
        symbols = np.full(int(sizes.sum()) + len(col), induced.SEPARATOR, np.uint8)
        places = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(col)), sizes)
        # UTF-8 has no bytes beyond F4, so two more symbols fit.
        symbols[places] = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]] + induced.FIRST_BYTE
        self.file.write(symbols.tobytes())
        self.size += len(symbols)
        self.own.append((rows.column("h").to_numpy(), rows.column("h2").to_numpy(), rows.column("first").to_numpy(), sizes))

    def repeated(self, size: int) -> pa.RecordBatch:
        """(h, h2, start, end) of the stretches whose every window also starts elsewhere in the shard."""
        self.file.write(bytes([induced.END]))
        self.file.flush()
        if self.size + 1 > induced.IN_MEMORY:
            data = np.memmap(self.file, np.uint8, "r", shape=(self.size + 1,))
        else:
            self.file.seek(0)
            data = np.frombuffer(self.file.read(), np.uint8)
        h, h2, first, sizes = (np.concatenate(c) for c in zip(*self.own, strict=True))
        begin = np.cumsum(sizes + 1) - sizes - 1
        p = np.flatnonzero(induced.repeated_windows(data, size))
        own = np.searchsorted(begin, p, "right") - 1
        inside = p - begin[own] <= sizes[own] - size
        p, own = p[inside], own[inside]
        new = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
        last = np.append(new[1:], len(p))[: len(new)] - 1
        own = own[new]
        start = first[own] + p[new] - begin[own]
        return pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(h2[own]), pa.array(start), pa.array(start + p[last] - p[new] + size)], names=["h", "h2", "start", "end"])


def _compare(pieces: DataFrame, size: int, shard_bytes: int = 2 << 20) -> DataFrame:
    """(h, h2, start, end): repeated stretches among the pieces (gram, h, h2, first, bytes) that share a gram.

    A task's pieces come in order of their grams; whole grams make shards of about `shard_bytes`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gram = _Shard(), None
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)] if len(grams) else []
            # Cut only where a gram ends and the shard is full.
            weights = np.diff(np.frombuffer(batch.column("bytes").cast(pa.large_binary()).buffers()[1], np.int64)).cumsum() if len(grams) else []
            at = 0
            for i, cut in enumerate(cuts[:-1]):
                full = shard.size + (int(weights[cut - 1]) - (int(weights[at - 1]) if at else 0) if cut > at else 0) >= shard_bytes
                if full and (i or gram != grams[0]):
                    if cut > at:
                        shard.add(batch.slice(at, cut - at))
                    yield shard.repeated(size)
                    shard, at = _Shard(), cut
            if len(grams):
                shard.add(batch.slice(at))
                gram = grams[-1]
        if shard.size:
            yield shard.repeated(size)

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(work, "h bigint, h2 int, start bigint, end bigint")


def _pieces(texts: DataFrame, runs: DataFrame, size: int, hot: int, step: int = 17) -> DataFrame:
    """(gram, h, h2, first, bytes) of the runs (h, h2, runs array<struct<gram,at,first,last,kinds>>)."""

    def parts(r):
        whole = F.array(F.struct(r["gram"].alias("gram"), r["first"].alias("first"), r["last"].alias("last")))

        def of_class(a):
            shared = F.substring("bytes", r["at"] - a + 1, F.lit(size - step + 1))
            return F.struct(F.xxhash64(r["gram"], a, shared).alias("gram"), F.greatest(r["first"], r["at"] - a - (step - 1)).alias("first"), F.least(r["last"], r["at"] - a).alias("last"))

        classes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - GRAM), F.lit(step)), of_class), lambda x: x["first"] <= x["last"])
        return F.when(r["kinds"] <= hot, whole).otherwise(classes)

    # Copies of a text are one text here.
    joined = texts.dropDuplicates(["h", "h2"]).join(runs, ["h", "h2"]).select("h", "h2", "runs", F.encode("text", "UTF-8").alias("bytes"))
    cut = joined.select("h", "h2", "bytes", F.explode(F.flatten(F.transform("runs", parts))).alias("p"))
    return cut.select("p.gram", "h", "h2", F.col("p.first").cast("bigint").alias("first"), F.substring("bytes", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + size).alias("bytes"))


def find_repeats(texts: DataFrame, size: int = 200, hot: int = 5000) -> DataFrame:
    """(h, h2, start, end) of texts (h, h2, text), bytes, end exclusive: stretches whose every `size`-byte window also
    starts elsewhere. Stretches of a text may touch or overlap; equal texts share (h, h2) and their stretches. Grams of
    more than `hot` contents are split."""
    by_gram, by_content = Window.partitionBy("gram"), Window.partitionBy("gram", "content")
    every = written(_find_runs(texts, size), "runs")
    # Dealt by gram once, which serves both windows.
    runs = every.where("sent").repartition("gram").withColumn("n", F.count("*").over(by_content)).withColumn("nth", F.row_number().over(by_content.orderBy("h", "h2", "first")))
    runs = runs.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(by_gram))
    runs = written(runs.where("kinds > 1 or n > 1 or repeated").drop("content", "sent"), "runs")
    span = ["h", "h2", F.col("first").cast("bigint").alias("start"), (F.col("last") + size).cast("bigint").alias("end")]
    whole = every.where("not sent").select(*span).union(runs.where("n > 1 or repeated").select(*span)).distinct()
    # Runs that share their gram with another content: one of each content is sorted.
    open_runs = runs.where("kinds > 1 and nth = 1").groupBy("h", "h2").agg(F.collect_list(F.struct("gram", "at", "first", "last", "kinds")).alias("runs"))
    return whole.union(written(_compare(_pieces(texts, open_runs, size, hot), size), "partly"))


def remove_repeats(df: DataFrame, text: str = "text", size: int = 200, removed: str = "removed", kept: str = "kept") -> DataFrame:
    """df with `removed` array<struct<start,end>> (maximal removed runs of UTF-8 bytes, end exclusive) and `kept` BINARY,
    the remaining bytes. The column of the text itself is left out.

    Null and empty texts, and texts shorter than `size`, keep all their bytes unless nothing is there to keep. Repeated rows
    are repeats of each other; null keys and other columns pass through; an empty table gives an empty one.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in (removed.lower(), kept.lower())))
    h, h2, own, spans = fresh(df, "h", "h2", "text_", "spans_")
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = spread(df).withColumns({h: F.xxhash64(whole), h2: F.hash(whole), own: whole})
    found = find_repeats(hashed.select(F.col(h).alias("h"), F.col(h2).alias("h2"), F.col(own).alias("text")), size)
    spans_of = found.groupBy("h", "h2").agg(F.collect_list(F.struct("start", "end")).alias(spans))
    spans_of = spans_of.select(F.col("h").alias(h), F.col("h2").alias(h2), spans)
    columns = [c for c in df.columns if c != text]
    joined = hashed.select(*columns, h, h2, own).join(spans_of, [h, h2], "left").select(*columns, own, spans)
    schema = ", ".join([*([df.select(*columns)._jdf.schema().toDDL()] if columns else []), f"`{removed}` array<struct<start:bigint,end:bigint>>, `{kept}` binary"])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
            cut, left = [], []
            for t, s in zip(batch.column(own), batch.column(spans), strict=True):
                data, merged = t.as_py().encode(), []
                for x in sorted(s.as_py() or [], key=lambda x: x["start"]):
                    if merged and x["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                    else:
                        merged.append(x)
                at, parts = 0, []
                for x in merged:
                    parts.append(data[at : x["start"]])
                    at = x["end"]
                cut.append(merged)
                left.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(cut, span_type), pa.array(left, pa.binary())], names=[*columns, removed, kept])

    return joined.mapInArrow(work, schema)
