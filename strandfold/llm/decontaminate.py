"""Benchmark decontamination by SimHash over item-sized windows.

Word shingles of a whole document are hashed at once over the Arrow buffer. For every size that a benchmark item has, the
document's windows of that size get a SimHash, and the items of that size whose fingerprints are within the radius are
found by multi-index Hamming blocks: 64 bits in 8 blocks, each probed with every value within radius // 8 bits, which by
the pigeonhole principle misses no fingerprint within the radius. The exact weighted similarity of shingle multisets
(sum of smaller over sum of larger counts) then decides about each candidate. The radius is 4.5 standard deviations above
the distance that two windows of the least similarity are expected to have.

Windows with fewer shingles of the benchmark as a whole than the similarity needs, whichever item they were compared with,
are left out before: that is an exact bound and finds no items.
The benchmark's shingles are broadcast in blocks of at most `block_shingles`; a larger benchmark makes more passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import fresh, holds, spread, text_slices

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M1 ^ (x >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _forget_powers() -> None:
    _POWERS[:] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    holds("powers", _forget_powers)
    if len(_POWERS[0]) < n:
        for k, base in enumerate((0x100000001B3, pow(0x100000001B3, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start byte, end byte, first shingle of each text and the total) of the word shingles of many texts.

    Words are runs of letters, digits and bytes above 127. A text of fewer words than `size` has one shingle of all of
    them; a text without words has none.
    """
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edge = inside[1:] != inside[:-1]
    # A text's end breaks a word.
    touching = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = touching[inside[touching] & inside[touching + 1]]
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    if len(joined):
        joined = np.unique(joined)
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    # Hash of a word: sum of byte times an odd base to the power of its place, from running sums modulo 2**64.
    powers, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * back[starts])
    first_word = np.searchsorted(starts, offsets)
    counts = np.diff(first_word)
    n_shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    if not first[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    text = np.repeat(np.arange(n), n_shingles)
    at = first_word[text] + np.arange(first[-1]) - first[text]
    length = np.minimum(counts[text], size)
    hashes = np.zeros(first[-1], np.uint64)
    for i in range(size):
        has = length > i
        hashes[has] = _mixed(hashes[has] * _M1 + words[at[has] + i])
    return hashes, starts[at], ends[at + length - 1], first


def simhash_windows(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """SimHash of the windows of `size` shingles that start at `at`."""
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[at + size] - sums[at]
    return ((ones * 2 > size).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Items:
    """A block of benchmark items: shingle multisets, and for each size the multi-index of their SimHashes."""

    def __init__(self, rows: list[tuple[int, str]], size: int, radius: int, least: float, blocks: int = 8) -> None:
        texts = [t.encode() for _, t in rows]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, _, _, first = shingle_hashes(data, offsets, size)
        self.radius, self.width, self.least = radius, 64 // blocks, least
        self.ids = [r[0] for r in rows]
        counts = np.diff(first)
        self.bags = [Counter(hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.keys = [np.array(sorted(bag), np.uint64) for bag in self.bags]
        self.known = np.unique(hashes)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        near = np.array([sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in combinations(range(self.width), k)])
        #: For each size: its items, their fingerprints, and for each block and value the bitmap of items to look at.
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sorted(set(counts.tolist()) - {0}):
            own = np.flatnonzero(counts == m)
            prints = np.array([simhash_windows(hashes[first[i] : first[i] + m], m, np.zeros(1, np.int64))[0] for i in own], np.uint64)
            index = np.zeros((blocks, 1 << self.width, -(-len(own) // 64)), np.uint64)
            for b in range(blocks):
                values = (prints >> np.uint64(b * self.width)).astype(np.int64) & (1 << self.width) - 1
                for j, value in enumerate(values.tolist()):
                    index[b, value ^ near, j // 64] |= np.uint64(1 << j % 64)
            self.of_size[m] = own, prints, index

    def need(self, window: int, m: int) -> int:
        """Shingles that a window and an item of m must have in common at least: similarity s of multisets of a and b
        needs s / (1 + s) * (a + b)."""
        return int(np.ceil(self.least / (1 + self.least) * (window + m) - 1e-9))

    def near(self, m: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in prints, item) of all items of m shingles within the radius of a fingerprint."""
        own, theirs, index = self.of_size[m]
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            look = np.zeros((len(part), index.shape[2]), np.uint64)
            for b in range(len(index)):
                look |= index[b, (part >> np.uint64(b * self.width)).astype(np.int64) & (1 << self.width) - 1]
            i, j = np.nonzero(np.unpackbits(look.view(np.uint8), axis=1, bitorder="little"))
            within = np.bitwise_count(part[i] ^ theirs[j]) <= self.radius
            yield at + i[within], own[j[within]]


def weighted_similarity(a: Counter, b: Counter) -> float:
    smaller = sum((a & b).values())
    return smaller / (sum(a.values()) + sum(b.values()) - smaller)


def _candidates(items: Items, hashes: np.ndarray, known: np.ndarray, reach: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item, window size, window starts) of one text for every item that the blocks find near its windows."""
    n, sums = len(hashes), np.concatenate([[0], np.cumsum(known)])
    for m in items.of_size:
        w = min(n, m)
        at = np.flatnonzero(sums[w:] - sums[:-w] >= items.need(w, m))
        found_at, found_item = [], []
        while len(at):
            some = at[: np.searchsorted(at, at[0] + reach)]
            at = at[len(some) :]
            prints = simhash_windows(hashes[some[0] : some[-1] + w], w, some - some[0])
            for place, item in items.near(m, prints):
                found_at.append(some[place])
                found_item.append(item)
        if found_at:
            place, item = np.concatenate(found_at), np.concatenate(found_item)
            for i in np.unique(item).tolist():
                yield i, w, place[item == i]


def _search(items: Items, data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, start byte, end byte) of the best window of each text for each item."""
    hashes, starts, ends, first = shingle_hashes(data, offsets, size)
    known = items.filter[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)]
    maybe = np.flatnonzero(known)
    if not len(maybe) or not len(items.known):
        return
    known[maybe] = items.known[np.minimum(np.searchsorted(items.known, hashes[maybe]), len(items.known) - 1)] == hashes[maybe]
    for t in np.unique(np.searchsorted(first, np.flatnonzero(known), "right") - 1).tolist():
        a, b = int(first[t]), int(first[t + 1])
        own = hashes[a:b]
        for i, w, at in _candidates(items, own, known[a:b]):
            # The exact similarity; only windows that share enough shingles with this item are counted out.
            low, high = int(at[0]), int(at[-1]) + w
            shared = np.concatenate([[0], np.cumsum(np.isin(own[low:high], items.keys[i]))])
            m = sum(items.bags[i].values())
            at = at[shared[at + w - low] - shared[at - low] >= items.need(w, m)]
            best = None
            for x in at.tolist():
                s = weighted_similarity(Counter(own[x : x + w].tolist()), items.bags[i])
                if s >= items.least and (best is None or s > best[0]):
                    best = (s, int(starts[a + x] - offsets[t]), int(ends[a + x + w - 1] - offsets[t]))
            if best:
                yield t, i, *best


def _item_blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items a bounded number at a time; what is in the driver at once is one block."""
    block, weight = [], 0
    for row in benchmark.select(F.col(item), F.lower(F.coalesce(F.col(text), F.lit("")))).toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            weight += len(row[1].split())
        if weight > most:
            yield block
            block, weight = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 5, least: float = 0.8, radius: int = 23, block_shingles: int = 1_000_000) -> DataFrame:
    """(key, item, similarity, start, end): for each document and benchmark item the window most similar to the item, if
    the similarity is at least `least`; start and end are bytes of the lower-cased text.

    Texts are lower-cased; words are runs of letters and digits. A document shorter than an item is a window as a whole.
    An item or document of fewer words than `size` has one shingle of all its words; without words (null, empty) it
    matches nothing. Repeated rows and null keys give rows of their own; ties go to the first window. Empty tables on
    either side give no rows; other columns are ignored.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    names = [key, item if item.lower() != key.lower() else "item", "similarity", "start", "end"]
    schema = f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, similarity double, start bigint, end bigint"
    lowered = spread(docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")))

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema[key].dataType), to_arrow_type(benchmark.schema[item].dataType), pa.float64(), pa.int64(), pa.int64()]
    passes = []
    for rows in _item_blocks(benchmark, item, item_text, block_shingles):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, size, radius, least)
            for batch in batches:
                keys = batch.column("key")
                found = []
                for i, _, data, offsets in text_slices(batch, "text"):
                    found += [(keys[i + t].as_py(), items.ids[n], *rest) for t, n, *rest in _search(items, data, offsets, size)]
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        passes.append(lowered.mapInArrow(work, schema))
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, judged row by row: other rows with the same id, or without one, do not count."""
    text = options.pop("text", "text")
    own, h, h2 = fresh(docs, "text_at", "h_", "h2_")
    whole = F.coalesce(F.col(text), F.lit(""))
    # Whether a row leaks depends on its text only.
    marked = docs.withColumn(own, F.struct(F.xxhash64(whole).alias("h"), F.hash(whole).alias("h2")))
    found = find_leaks(marked, benchmark, own, text, **options).select(F.col(f"{own}.h").alias(h), F.col(f"{own}.h2").alias(h2)).distinct()
    return marked.join(found, (F.col(f"{own}.h") == F.col(h)) & (F.col(f"{own}.h2") == F.col(h2)), "left_anti").select(*docs.columns)
