"""Repeated windows of a shard of strings by external induced sorting.

The shard's strings, parted by separators, are one text of symbols. Its suffixes are sorted by induction: suffixes of
type L (greater than the one after them) and S are queued by their first symbol as soon as the suffix after them is
taken from the queue, so each is put behind all smaller ones of its symbol. The leftmost S suffixes (LMS) from which
induction starts are named by their substrings, and their order is found by recursion on the string of names.

In the last two passes over the text every queue entry also carries the length of the prefix that it shares with the entry
before it: one more than the least length seen since the last entry for its symbol was queued. Neighbours that share
`size` bytes or more are repeated windows.

A queue is a monotone bucket priority queue: one front a symbol, in an array that lies on disk when it is large. What is
taken at once is the longest stretch of symbols to which nothing more can come, which keeps the work in numpy blocks.
Files are unlinked as they are made: a task that ends or dies leaves nothing.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Arrays larger than this many bytes are files.
IN_MEMORY = 96 << 20
#: Strings of at most so many names are sorted directly: the end of the recursion.
DIRECT = 1 << 19
#: Symbols: the end, separators, then bytes.
END, SEPARATOR, FIRST_BYTE = 0, 1, 2


def stored(n: int, dtype) -> np.ndarray:
    """An array of n items, in memory or, if large, in an unlinked file."""
    if n * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


def _types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are of type L; the last symbol is the only one of its kind and the smallest."""
    edge = np.flatnonzero(s[1:] != s[:-1])
    run_is_l = np.append(s[edge] > s[edge + 1], False)
    return np.repeat(run_is_l, np.diff(np.concatenate([[-1], edge, [len(s) - 1]])))


class _Shared:
    """Lengths of prefixes shared with the entry queued before for the same symbol."""

    def __init__(self, symbols: int, out: np.ndarray, most: int) -> None:
        self.out, self.most = out, most
        self.inf = np.iinfo(out.dtype).max
        self.tail = np.zeros(symbols, out.dtype)  # least length after the symbol's last entry, in that entry's block
        self.block = np.zeros(symbols, np.int64)
        self.later, self.blocks = np.full(1024, self.inf, out.dtype), 0  # least length in all blocks after block i

    def queue(self, lengths: np.ndarray, at: np.ndarray, symbol: np.ndarray, first: np.ndarray, slot: np.ndarray) -> None:
        """Entries of the sources `at` (places in the block), grouped by symbol; `first` marks each group's first."""
        # Least of lengths[a + 1 .. b] for neighbours a, b of a group, from minima over stretches of powers of two.
        before = np.empty(len(at), np.int64)
        before[1:] = at[:-1]
        value = np.empty(len(at), lengths.dtype)
        inner = np.flatnonzero(~first)
        gap = at[inner] - before[inner]
        level = np.frexp(gap.astype(np.float64))[1] - 1
        table, width = lengths, 1
        for k in range(int(level.max()) + 1 if len(level) else 0):
            if k:
                table = np.minimum(table[:-width], table[width:])
                width *= 2
            own = inner[level == k]
            if len(own):
                value[own] = np.minimum(table[before[own] + 1], table[at[own] - width + 1])
        head = np.flatnonzero(first)
        s = symbol[head]
        upto = np.minimum.accumulate(lengths)
        value[head] = np.minimum(np.minimum(upto[at[head]], self.tail[s]), self.later[self.block[s]])
        self.out[slot] = np.minimum(value, self.most - 1) + 1
        # What comes after each symbol's last entry of this block.
        last = np.append(head[1:], len(at)) - 1
        onward = np.append(np.minimum.accumulate(lengths[::-1])[::-1], self.inf).astype(lengths.dtype)
        self.close(onward[0])
        self.tail[s], self.block[s] = onward[at[last] + 1], self.blocks - 1

    def close(self, least) -> None:
        """A block ends whose least length is `least`."""
        np.minimum(self.later[: self.blocks], least, out=self.later[: self.blocks])
        if self.blocks + 1 >= len(self.later):
            self.later = np.concatenate([self.later, np.full_like(self.later, self.inf)])
        self.blocks += 1


def induce(marked: np.ndarray, symbols: int, seeds: np.ndarray, own: np.ndarray, shared: tuple | None = None, block: int = 1 << 16):
    """All suffixes of the type induced, in order.

    marked: twice the symbol, plus 1 if the suffix here is of that type. seeds: the suffixes of the other type from which
    induction starts, in order; own: their symbols. A symbol's seeds come after its induced suffixes.
    shared: (lengths shared by neighbouring seeds, run lengths of equal symbols, most); then also the lengths that
    neighbouring results share, 0 where the symbol changes.
    """
    end = np.cumsum(np.bincount(marked[(marked & 1).astype(bool)] >> 1, minlength=symbols))
    begin = np.append(0, end[:-1])
    head = begin.copy()
    seed_end = np.searchsorted(own, np.arange(symbols), "right")
    out = stored(int(end[-1]), np.int32)
    lengths = None
    if shared:
        seed_lengths, runs, most = shared
        kept = _Shared(symbols, stored(len(out), seed_lengths.dtype), most)
        lengths = kept.out

    def take(x: np.ndarray, length: np.ndarray | None) -> None:
        """Queue the suffixes before the suffixes x."""
        if not len(x):
            return
        before = marked[x - 1]
        at = np.flatnonzero(before & 1)
        if not len(at):
            if shared:
                kept.close(length.min())
            return
        symbol = before[at] >> 1
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.append(True, symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(first)
        n = np.diff(np.append(starts, len(at)))
        each = symbol[starts]
        slot = np.repeat(head[each] - starts, n) + np.arange(len(at))
        head[each] += n
        out[slot] = x[at] - 1
        if shared:
            kept.queue(length, at, symbol, first, slot)

    def seam(c: int) -> int:
        """What a symbol's last induced suffix and its first seed share: the shorter run of the symbol."""
        return int(min(runs[out[end[c] - 1]], runs[seeds[seed_end[c - 1] if c else 0]]))

    c, scanned = 0, 0
    while c < symbols:
        # Symbols whose suffixes are all queued can be taken together.
        ahead = head[c : c + 4096] != end[c : c + 4096]
        stop = c + (int(ahead.argmax()) if ahead.any() else len(ahead))
        if stop == c:
            # More of the same symbol comes from its own suffixes.
            at = int(begin[c])
            while at < head[c]:
                to = min(int(head[c]), at + block)
                length = None
                if shared:
                    length = lengths[at:to].copy()
                    if at == begin[c]:
                        length[0] = 0
                take(np.asarray(out[at:to]), length)
                at = to
            a, b = (int(seed_end[c - 1]) if c else 0), int(seed_end[c])
            for at in range(a, b, block):
                length = None
                if shared:
                    length = seed_lengths[at : min(b, at + block)].copy()
                    if at == a:
                        length[0] = seam(c) if end[c] > begin[c] else 0
                take(seeds[at : min(b, at + block)], length)
            c += 1
            continue
        taken = (end[c:stop] - begin[c]) + (seed_end[c:stop] - (seed_end[c - 1] if c else 0))
        stop = c + max(1, int(np.searchsorted(taken, block, "right")))
        a, b = (int(seed_end[c - 1]) if c else 0), int(seed_end[stop - 1])
        i, j = int(begin[c]), int(end[stop - 1])
        x = np.concatenate([out[i:j], seeds[a:b]])
        wide = np.arange(c, stop)
        n_own, n_seed = end[c:stop] - begin[c:stop], seed_end[c:stop] - np.append(a, seed_end[c : stop - 1])
        length = None
        if shared:
            length = np.concatenate([lengths[i:j], seed_lengths[a:b]])
            length[begin[c:stop][n_own > 0] - i] = 0
            at = np.flatnonzero(n_seed > 0)
            places = np.append(a, seed_end[c : stop - 1])[at] - a + (j - i)
            length[places] = 0
            both = n_own[at] > 0
            if both.any():
                u, v = out[end[c:stop][at[both]] - 1], x[places[both]]
                length[places[both]] = np.minimum(runs[u], runs[v])
        if b > a and j > i:
            order = np.argsort(np.concatenate([np.repeat(wide, n_own), np.repeat(wide, n_seed)]), kind="stable")
            x = x[order]
            length = length[order] if shared else None
        for at in range(0, len(x), block):
            take(x[at : at + block], length[at : at + block] if shared else None)
        c = stop
    if shared:
        full = np.flatnonzero(end > begin)
        lengths[begin[full]] = 0
    return out, lengths


def _marks(s: np.ndarray, symbols: int, is_l: np.ndarray, mirrored: bool) -> np.ndarray:
    """Symbol and type in one number; mirrored: in the opposite order of symbols, where S suffixes are the induced ones."""
    kind = np.uint16 if 2 * symbols + 1 < 1 << 16 else np.int64
    if not mirrored:
        return s.astype(kind) * kind(2) + is_l
    out = (kind(symbols - 1) - s.astype(kind)) * kind(2) + ~is_l
    out[-1] -= 1  # nothing comes after the end, so nothing induces it
    return out


def _both(s: np.ndarray, symbols: int, is_l: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L suffixes, S suffixes without the end), each in order, from LMS suffixes in order."""
    large, _ = induce(_marks(s, symbols, is_l, False), symbols, seeds, s[seeds])
    back = np.asarray(large[::-1])
    small, _ = induce(_marks(s, symbols, is_l, True), symbols, back, symbols - 1 - s[back].astype(np.int64))
    return large, small[::-1]


def sorted_lms(s: np.ndarray, symbols: int, is_l: np.ndarray) -> np.ndarray:
    """The LMS suffixes of s in order; s ends with its only 0."""
    starts = np.flatnonzero(~is_l[1:] & is_l[:-1]) + 1
    if len(starts) < 3:
        return starts[::-1] if len(starts) == 1 or len(starts) == 2 else starts
    _, small = _both(s, symbols, is_l, starts[np.argsort(s[starts], kind="stable")])
    small = np.asarray(small)
    found = np.append(len(s) - 1, small[(small > 0) & is_l[small - 1]]).astype(np.int64)
    # Equal substrings, from one LMS to the next, get one name.
    place = np.searchsorted(starts, found)
    size = np.append(np.diff(starts), 0)[place]
    same, equal = np.flatnonzero(size[1:] == size[:-1]) + 1, np.zeros(len(found), bool)
    for k in range(int(size.max()) + 1):
        same = same[s[found[same] + k] == s[found[same - 1] + k]]
        done = size[same] == k
        equal[same[done]] = True
        same = same[~done]
        if not len(same):
            break
    names = np.cumsum(~equal) - 1
    if names[-1] == len(found) - 1:
        return found
    reduced = np.empty(len(starts), np.int32)
    reduced[place] = names
    return starts[_suffix_order(reduced, int(names[-1]) + 1)]


def _sorted_directly(s: np.ndarray) -> np.ndarray:
    """By ranks of prefixes that double in length until all differ."""
    rank, width = s.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key)
        new = np.append(False, np.diff(key[order]) != 0)
        rank[order] = np.cumsum(new)
        width *= 2
        if new.sum() == len(s) - 1 or width >= len(s):
            return order


def _suffix_order(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of s in order; s ends with its only 0."""
    if len(s) <= DIRECT:
        return _sorted_directly(s)
    is_l = _types(s)
    large, small = _both(s, symbols, is_l, sorted_lms(s, symbols, is_l))
    every = np.concatenate([[len(s) - 1], large, small])
    return every[np.argsort(s[every], kind="stable")]


def _shared_by_neighbours(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each of the suffixes shares with the one before it, at most `most`; eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.zeros(len(order), np.uint8 if most < 256 else np.uint16)
    open_ = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for k in range(0, most, 8):
        differ = words[a + k] ^ words[b + k]
        ended = differ != 0
        d = differ[ended]
        out[open_[ended]] = np.minimum(k + np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) // 8, most)
        stay = ~ended
        open_, a, b = open_[stay], a[stay], b[stay]
        if not len(open_):
            return out
    out[open_] = most
    return out


def repeated_windows(data: np.ndarray, size: int) -> np.ndarray:
    """For a text of symbols (uint8: separators SEPARATOR, bytes from FIRST_BYTE, the last symbol END): which windows of
    `size` symbols also start elsewhere. Windows over a separator do not count (the caller leaves them out)."""
    is_l = _types(data)
    symbols = int(data.max()) + 1
    most = size + 8 - size % 8
    kind = np.uint8 if most < 255 else np.uint16
    seeds = sorted_lms(data, symbols, is_l)
    edge = np.flatnonzero(data[1:] != data[:-1])
    stop = np.append(edge + 1, len(data))
    length = np.diff(np.append(0, stop))
    runs = np.minimum(np.repeat(stop, length) - np.arange(len(data)), most).astype(kind)
    shared = _shared_by_neighbours(data, seeds, most).astype(kind)
    out = np.zeros(len(data), bool)

    def mark(order: np.ndarray, lengths: np.ndarray) -> None:
        hit = np.flatnonzero(lengths >= size)
        out[order[hit]] = True
        out[order[hit - 1]] = True

    large, lengths = induce(_marks(data, symbols, is_l, False), symbols, seeds, data[seeds], (shared, runs, most))
    mark(large, lengths)
    back = np.asarray(large[::-1])
    turned = np.append(0, lengths[:0:-1]).astype(kind)
    small, lengths = induce(_marks(data, symbols, is_l, True), symbols, back, symbols - 1 - data[back].astype(np.int64), (turned, runs, most))
    mark(small, lengths)
    # Windows of one symbol only are of both types.
    alike = np.flatnonzero(runs >= size)
    if len(alike):
        out[alike[np.bincount(data[alike], minlength=256)[data[alike]] > 1]] = True
    return out
