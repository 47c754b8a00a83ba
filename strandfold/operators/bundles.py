"""Super-mers as bytes: what moves between tasks, or is staged, instead of k-mers.

A bundle holds the super-mers that a piece of input has for one part: their numbers of windows (16 bits each) and their
bases, two bits each, every super-mer from a whole byte on. So a k-mer costs one or two bytes to move, not the 16 to 48 of
its words and count. All windows of one k-mer have one part, as the part follows from the m-mers in it; a task counts part
by part, and its memory follows `HELD`, not the part: what is more than that lies in temporary files until it is counted.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandfold.functions import bases
from strandfold.operators.kmers import _CODES, WORD, buffers, dealt, pieces, scanned_bytes, valid_windows, words_of

#: Windows of one super-mer at most; words that a task holds before it sums them or puts them aside; files that it deals them to.
SPAN, HELD, FILES = (1 << 16) - 1, 1 << 22, 64
#: The columns of a bundle that is staged; every k-mer in it stands for `copies`.
BUNDLE = ["n_kmers", "smers", "copies", "lengths", "bases"]
_LETTERS = np.frombuffer(bases.BASES.encode(), np.uint8)
_FOURS = np.array([[_LETTERS[b >> s & 3] for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)


def minimizer(k: int) -> int:
    """The length of the m-mers that parts follow from."""
    return 8 if k < 24 else 12 if k < 48 else 16


def least_of(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive values."""
    width = 1
    while 2 * width <= w:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return np.minimum(values[: len(values) - (w - width)], values[w - width :]) if width < w else values


def least_hashes(data: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """For every window of k bytes the least 32-bit hash of its m-mers; it has no meaning where not all are bases."""
    m = minimizer(k)
    forward = (_CODES[data] & 3).astype(np.uint32)
    reverse, width, whole = 3 - forward, 1, []
    while True:
        if m & width:
            whole.append((forward, reverse, width))
        if 2 * width > m:
            break
        s, size = np.uint32(2 * width), len(forward) - width
        forward, reverse, width = (forward[:size] << s) | forward[width:], reverse[:size] | (reverse[width:] << s), 2 * width
    forward, reverse, width = whole[0]
    for f, r, more in whole[1:]:
        size = min(len(forward), len(f) - width)
        forward, reverse, width = (forward[:size] << np.uint32(2 * more)) | f[width : width + size], reverse[:size] | (r[width : width + size] << np.uint32(2 * width)), width + more
    code = np.minimum(forward, reverse) if canonical else forward
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code = (code ^ (code >> np.uint32(12))) * np.uint32(0x297A2D39)
    return least_of(code ^ (code >> np.uint32(15)), k - m + 1)


def stretches(valid: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of maximal stretches of valid windows of one part, none longer than SPAN."""
    inner = valid[1:] & valid[:-1] & (part[1:] == part[:-1])
    first = np.flatnonzero(valid & ~np.append(False, inner))
    n = np.flatnonzero(valid & ~np.append(inner, False)) - first + 1
    if len(n) and n.max() > SPAN:
        times = -(-n // SPAN)
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, n = np.repeat(first, times) + at * SPAN, np.minimum(np.repeat(n, times) - at * SPAN, SPAN)
    return first, n


def fours(data: np.ndarray) -> np.ndarray:
    """For each place the byte of the four bases from there on."""
    c = np.append(_CODES[data] & 3, np.zeros(3, np.uint8))
    return c[:-3] << 6 | c[1:-2] << 4 | c[2:-1] << 2 | c[3:]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def bundled(quads: np.ndarray, first: np.ndarray, n: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(key, k-mers, super-mers, lengths, bases) of a bundle for each key; quads: fours() of the piece."""
    order = np.argsort(key, kind="stable")
    first, n, key = first[order], n[order], key[order]
    size = (n + k + 2) >> 2
    ends = np.cumsum(size)
    packed = quads.take(np.repeat(first - 4 * (ends - size), size) + 4 * np.arange(ends[-1]), mode="clip")
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    per = lambda total: np.diff(np.append(0, total[last]))
    return key[last], per(np.cumsum(n)), np.diff(np.append(-1, last)), _binary(n.astype("<u2"), 2 * (last + 1)), _binary(packed, ends[last])


def window_places(lengths: np.ndarray, k: int) -> np.ndarray:
    """The first base of every window among the bases of super-mers."""
    n = lengths.astype(np.int64)
    size, ends = 4 * ((n + k + 2) >> 2), np.cumsum(n)
    return np.repeat(np.cumsum(size) - size - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def _flipped(code: np.ndarray, width: int) -> np.ndarray:
    """Codes of the reverse complements."""
    x = ~code
    for s, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(s)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(s))
    return x.byteswap() >> np.uint64(64 - 2 * width)


def words_in(packed: np.ndarray, places: np.ndarray, k: int, canonical: bool) -> list[np.ndarray]:
    """window_words() of the windows at `places` of packed bases."""
    byte = np.append(packed, np.zeros(9, np.uint8))
    # 32 bases from every byte on, and the four after them.
    eight, width = byte[:-1].astype(np.uint64), 1
    while width < 8:
        eight, width = (eight[:-width] << np.uint64(8 * width)) | eight[width:], 2 * width
    next_ = byte[8:]

    def read(at: np.ndarray, width: int) -> np.ndarray:
        q, s = at >> 2, ((at & 3) << 1).astype(np.uint64)
        code = (eight[q] << s) | (next_[q].astype(np.uint64) >> (np.uint64(8) - s))
        return code >> np.uint64(64 - 2 * width)

    starts = [(p, min(WORD, k - p)) for p in range(0, k, WORD)]
    forward = [read(places + p if p else places, w) for p, w in starts]
    if not canonical:
        return [f.view(np.int64) for f in forward]
    if len(forward) == 1:
        return [np.minimum(forward[0], _flipped(forward[0], k)).view(np.int64)]
    reverse = [_flipped(read(places + (k - p - w), w), w) for p, w in starts]
    swap, same = np.zeros(len(places), bool), np.ones(len(places), bool)
    for f, r in zip(forward, reverse, strict=True):
        swap |= same & (r < f)
        same &= r == f
    return [np.where(swap, r, f).view(np.int64) for f, r in zip(forward, reverse, strict=True)]


def hashed(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def summed(words: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """(words, sums of n) of different rows of words, each row once; n None: every row is one."""
    if len(words) == 1 and n is None:
        ordered = [np.sort(words[0])]
    else:
        key = words[0] if len(words) == 1 else hashed(words)
        order = np.argsort(key)
        ordered = [w[order] for w in words]
        if len(words) > 1:
            key = key[order]
            differs = np.logical_or.reduce([w[1:] != w[:-1] for w in ordered])
            if (differs & (key[1:] == key[:-1])).any():  # a hash of two k-mers: rows of one k-mer may lie apart
                order = np.lexsort(words)
                ordered = [w[order] for w in words]
        n = None if n is None else n[order]
    first = np.flatnonzero(np.append(True, np.logical_or.reduce([w[1:] != w[:-1] for w in ordered]))) if len(ordered[0]) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(ordered[0]))) if n is None else np.add.reduceat(n, first) if len(first) else n
    return [w[first] for w in ordered], sums.astype(np.int64)


class Tally:
    """Sums by words in bounded memory: beyond `held` words, what is not summed away is dealt to temporary files by hash, and
    each file is summed alone, or dealt again."""

    def __init__(self, words: int, held: int = HELD, level: int = 0) -> None:
        self.width, self.held, self.level = words, held, level
        self.rows: list[tuple[list[np.ndarray], np.ndarray | None]] = []
        self.size, self.files = 0, []

    def add(self, words: list[np.ndarray], n: np.ndarray | None = None) -> None:
        self.rows.append((words, n))
        self.size += len(words[0])
        if self.size * self.width >= self.held:
            self._sum()
            if 2 * self.size * self.width >= self.held:
                self._put_aside()

    def _sum(self) -> None:
        words = [np.concatenate(c) for c in zip(*(w for w, _ in self.rows), strict=True)]
        plain = all(n is None for _, n in self.rows)
        n = None if plain else np.concatenate([np.ones(len(w[0]), np.int64) if n is None else n for w, n in self.rows])
        self.rows.clear()
        self.rows.append(summed(words, n))
        self.size = len(self.rows[0][1])

    def _put_aside(self) -> None:
        ((words, n),) = self.rows
        digit = ((hashed([w ^ np.int64(self.level) for w in words]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58)).astype(np.uint8)
        order = np.argsort(digit, kind="stable")
        edges = np.searchsorted(digit[order], np.arange(FILES + 1))
        rows = np.stack([*(w[order] for w in words), n[order]], axis=1)
        self.files = self.files or [tempfile.TemporaryFile() for _ in range(FILES)]
        for file, a, b in zip(self.files, edges, edges[1:], strict=False):
            file.write(memoryview(rows[a:b]).cast("B") if b > a else b"")
        self.rows, self.size = [], 0

    def done(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """All sums, every row of words once; nothing is left."""
        if self.rows:
            self._sum()
        if not self.files:
            yield from self.rows
        else:
            if self.rows:
                self._put_aside()
            for file in self.files:
                inner = Tally(self.width, self.held, self.level + 1)
                file.seek(0)
                while data := file.read((self.held // 8 // self.width + 1) * 8 * (self.width + 1)):
                    rows = np.frombuffer(data, np.int64).reshape(-1, self.width + 1)
                    inner.add([np.ascontiguousarray(rows[:, i]) for i in range(self.width)], rows[:, -1].copy())
                file.close()
                yield from inner.done()
        self.rows, self.size, self.files = [], 0, []


def spelled_array(words: list[np.ndarray], k: int) -> pa.Array:
    """Strings of the k-mers of words."""
    out = np.empty((len(words[0]), k), np.uint8)
    for i, w in enumerate(words):
        width = min(WORD, k - i * WORD)
        byte = (w.view(np.uint64) << np.uint64(64 - 2 * width)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 4)]
        out[:, i * WORD : i * WORD + width] = _FOURS[byte].reshape(len(w), -1)[:, :width]
    return pa.LargeStringArray.from_buffers(len(out), pa.py_buffer(np.arange(0, out.size + 1, k, dtype=np.int64)), pa.py_buffer(out))


def runs_of(column: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]]) if len(column) else []
    return zip(edges[:-1], edges[1:], strict=True)


def raw(column: pa.Array, a: int, b: int, dtype: str) -> np.ndarray:
    """The bytes of rows a to b of a binary column, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
    if column.buffers()[2] is None:
        return np.zeros(0, dtype)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[a] : offsets[b]].view(dtype)


def added(tally: Tally, lengths: np.ndarray, packed: np.ndarray, k: int, canonical: bool, copies: np.ndarray | None, most: int = 1 << 19, ahead: int | None = None) -> None:
    """Put the windows of super-mers into a tally, about `most` at a time; copies: for each super-mer; ahead: a word
    that stands before the others."""
    if not len(lengths):
        return
    n = np.cumsum(lengths, dtype=np.int64)
    at = np.cumsum((lengths.astype(np.int64) + k + 2) >> 2)
    cuts = np.unique(np.append(np.searchsorted(n, np.arange(most, n[-1], most)), len(n)))
    for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        if b > a:
            places = window_places(lengths[a:b], k)
            words = words_in(packed[at[a - 1] if a else 0 : at[b - 1]], places, k, canonical)
            words = words if ahead is None else [np.full(len(places), ahead, np.int64), *words]
            tally.add(words, None if copies is None else np.repeat(copies[a:b], lengths[a:b]))


def told(tally: Tally, k: int, least: int, spell: bool, bin_: int | None = None) -> Iterator[pa.RecordBatch]:
    """The sums of `least` or more as rows of words or strings; bin_: in a column before them."""
    names = [*(["bin"] if bin_ is not None else []), *(["kmer"] if spell else words_of(k)), "cnt"]
    for words, n in tally.done():
        if least > 1:
            kept = np.flatnonzero(n >= least)
            words, n = [w[kept] for w in words], n[kept]
        for at in range(0, len(n), step := (1 << 23) // k):
            own = [w[at : at + step] for w in words]
            columns = [spelled_array(own, k).cast(pa.string())] if spell else list(map(pa.array, own))
            of_bin = [pa.array(np.full(len(own[0]), bin_, np.int64))] if bin_ is not None else []
            yield pa.RecordBatch.from_arrays([*of_bin, *columns, pa.array(n[at : at + step])], names=names)


def hash_parts(data: np.ndarray, k: int, canonical: bool, bits: int) -> np.ndarray:
    """A part of 2^bits for every window of k bytes."""
    return ((least_hashes(data, k, canonical) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)


def _rows(data: np.ndarray, offsets: np.ndarray, k: int, canonical: bool, parts: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(data) < k:
        return
    valid, part = valid_windows(data, offsets, k), parts(data)
    first, n = stretches(valid, part)
    if not len(first):
        return
    quads, own = fours(data), part[first]
    # Where one part holds much of a piece, few k-mers may fill it: they go one by one, once each, with their number.
    heavy = np.flatnonzero(np.bincount(own, n) > max(1 << 14, valid.sum() >> 3))
    if len(heavy):
        among = np.isin(own, heavy)
        starts = np.flatnonzero(valid & np.isin(part, heavy))
        words = words_in(quads[::4], starts, k, canonical)
        order = np.lexsort([*words[::-1], part[starts]])
        new = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in [part[starts], *words]]))
        copies = np.diff(np.append(np.flatnonzero(new), len(order)))
        places = starts[order][new]
        key, _, many, lengths, packed = bundled(quads, places, np.ones(len(places), np.int64), part[places], k)
        yield pa.RecordBatch.from_arrays([pa.array(key), lengths, packed, _binary(copies.astype("<i8"), 8 * np.cumsum(many))], names=["part", "lengths", "bases", "copies"])
        first, n, own = first[~among], n[~among], own[~among]
    if len(first):
        key, _, _, lengths, packed = bundled(quads, first, n, own, k)
        yield pa.RecordBatch.from_arrays([pa.array(key), lengths, packed, pa.nulls(len(key), pa.binary())], names=["part", "lengths", "bases", "copies"])


def layout(reads: DataFrame) -> tuple[int, int]:
    """(bits of the parts' numbers, tasks) for what the plan says is scanned: about a million bases a part, and tasks of a few
    parts each. They decide how the work is dealt, not how much memory it takes. Spark gives 2^63 - 1 where it does not know."""
    scanned = scanned_bytes(reads)
    scanned = scanned if scanned < 1 << 50 else 1 << 28
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(13, max(7, (scanned >> 19).bit_length())), max(tasks, min(2048, scanned >> 23))


def by_part(reads: DataFrame, k: int, canonical: bool, parts: Callable[[np.ndarray], np.ndarray], told: Callable[[Tally, int], Iterator[pa.RecordBatch]], schema: str, seq: str = "seq", apart: int = 31, most: int = 1 << 20) -> DataFrame:
    """What `told` makes of the sums of parts, each in one task. parts: the part of every window of k bytes of a piece, which
    the k-mer there decides. Parts that agree in the bits from `apart` on may be summed together, as no k-mer is in two."""
    width, (_, tasks) = len(words_of(k)), layout(reads)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in pieces(*buffers(batch.column(0)), k, most):
                yield from _rows(data, offsets, k, canonical, parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, current = Tally(width), None
        for batch in batches:
            part, copies = batch.column("part").to_numpy(), batch.column("copies")
            single = copies.is_null().to_numpy(zero_copy_only=False)
            for a, b in runs_of(2 * part.astype(np.int64) + single):
                own = int(part[a])
                if own != current and current is not None and (own >> apart != current >> apart or tally.size * width > HELD // 8 or tally.files):
                    yield from told(tally, current >> apart)
                current = own
                added(tally, raw(batch.column("lengths"), a, b, "<u2"), raw(batch.column("bases"), a, b, "u1"), k, canonical, None if single[a] else raw(copies, a, b, "<i8"))
        if current is not None:
            yield from told(tally, current >> apart)

    moved = dealt(reads.select(seq)).mapInArrow(bundle, "part int, lengths binary, bases binary, copies binary").repartition(tasks, "part")
    return moved.sortWithinPartitions("part").mapInArrow(work, schema)


def count(reads: DataFrame, k: int, canonical: bool = True, seq: str = "seq", least: int = 1, spell: bool = False, most: int = 1 << 20) -> DataFrame:
    """(words_of(k), cnt), or (kmer, cnt) if spelled, of the k-mers that occur `least` times or more; k from 15 on."""
    bits, _ = layout(reads)
    schema = "kmer string, cnt bigint" if spell else ", ".join(f"{c} bigint" for c in [*words_of(k), "cnt"])
    return by_part(reads, k, canonical, lambda data: hash_parts(data, k, canonical, bits), lambda tally, _: told(tally, k, least, spell), schema, seq, most=most)


def distinct_by(reads: DataFrame, key: str, k: int, canonical: bool = True, seq: str = "seq", most: int = 1 << 20) -> DataFrame:
    """(key, n_kmers, n_distinct): k-mers of the rows of each key, which meet in one task as bundles."""
    width, (_, tasks) = len(words_of(k)), layout(reads)
    kind = reads.schema[key].dataType

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, (piece, inner) in enumerate(pieces(data, offsets, k, most)):
                row = np.repeat(np.searchsorted(offsets, i * most, "right") - 1 + np.arange(len(inner) - 1), np.diff(inner))[: len(piece) - k + 1]
                first, n = stretches(valid_windows(piece, inner, k), row)
                if len(first):
                    own, _, _, lengths, packed = bundled(fours(piece), first, n, row[first], k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), lengths, packed], names=[key, "lengths", "bases"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys are numbered as they come, and the number is a word more: many keys are summed at once, a large one in files.
        tally, ids, id_type = Tally(width + 1), [], None

        def numbers() -> Iterator[pa.RecordBatch]:
            total, distinct = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for words, n in tally.done():
                distinct += np.bincount(words[0], minlength=len(ids))
                np.add.at(total, words[0], n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(total), pa.array(distinct)], names=[key, "n_kmers", "n_distinct"])
            ids.clear()

        for batch in batches:
            id_type = batch.column(0).type
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            for a, b in runs_of(code):
                own = batch.column(0)[a].as_py()
                if not ids or own != ids[-1]:
                    if ids and (tally.size * tally.width > HELD // 8 or tally.files):
                        yield from numbers()
                    ids.append(own)
                added(tally, raw(batch.column("lengths"), a, b, "<u2"), raw(batch.column("bases"), a, b, "u1"), k, canonical, None, ahead=len(ids) - 1)
        if ids:
            yield from numbers()

    of_key = StructType([StructField(key, kind), StructField("lengths", BinaryType()), StructField("bases", BinaryType())])
    moved = dealt(reads.select(key, seq)).mapInArrow(bundle, of_key).repartition(tasks, key).sortWithinPartitions(key)
    return moved.mapInArrow(work, StructType([StructField(key, kind), StructField("n_kmers", LongType()), StructField("n_distinct", LongType())]))
