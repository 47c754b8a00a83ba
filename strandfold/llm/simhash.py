"""SimHash near-duplicates: fingerprints of whole texts, a binary-trie self-join, connected components.

The trie is never built whole. Distinct fingerprints are dealt to subtries by their leading bits; a pair of subtries whose
prefixes already differ in more bits than the budget is pruned before any row moves, each remaining pair of subtries is
one group. Inside a group the two tries are sorted arrays and a trie node is a range of them; node pairs are traversed
together, differing bits accumulate, and a pair is pruned as soon as they exceed the budget. A group gives a spanning
forest of its links (at most one link per fingerprint), so a dense cluster does not become all its pairs.

Texts of a similarity at which 64 bits differ too often for a trie to prune get wide fingerprints instead, of several words
of 64 bits. They are cut into sections, one trie table each: two texts meet if in any table their sections differ in at most
one bit, and their first words then tell whether they are near (wide_links()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import components, holds, keep_one, spread, written

BITS = 64
#: Words are runs of other characters than these (fixed values of the contract).
SPACE = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}
_BREAKS = {ord(c): " " for c in SPACE}


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_LOWER | _BREAKS).split(" ") if w] if not text.isascii() else _ascii_words(text)


def _ascii_words(text: str) -> list[str]:
    # bytes.split() breaks at exactly SPACE; str.split() would also break at the separators 1C to 1F.
    return text.encode().lower().decode().split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().lower().split()]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42), repeats included; no word: zero."""
    words = words_of(text) if text else []
    if not words:
        return 0
    runs = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
    h = xxhash.xxh64_intdigest
    values = np.fromiter((h(s, 42) for s in runs), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


#: Wide fingerprints: the bits that may differ in the first word, the first two and the first three, which are compared
#: whole, and the share of pairs of the least similarity that no section may bring together.
WITHIN, MISS = (29, 48, 64), 1e-6
WHOLE = len(WITHIN)
_STEPS = np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIXED = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def wide_fingerprint(values: np.ndarray, words: int) -> np.ndarray:
    """The bits (0 or 1) of `words` fingerprints of the distinct hashes `values`: word w is the one of mix(value, w)."""
    counts = np.zeros(words * BITS, np.int64)
    for at in range(0, len(values), 255):
        h = values[at : at + 255, None] + _STEPS[:words]
        for shift, factor in _MIXED:
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (counts * 2 > len(values)).astype(np.uint8)


@lru_cache(maxsize=None)
def differing(least: float, n: int, exact: int = 40) -> float:
    """The probability, at most, that a bit differs between a set of n values and any set of a similarity of `least` or more.

    Never less than by the angle of sets of equal size; counted for sets of up to `exact` values, where ties of few values
    weigh more, and taken from the largest of these for larger sets.
    """
    angle = math.acos(2 * least / (1 + least)) / math.pi
    if n > exact:
        return max(differing(least, k) for k in range(exact - 9, exact + 1))
    chances = lambda k: [(2 * i - k, math.comb(k, i) / 2**k) for i in range(k + 1)]
    worst = angle
    for m in range(max(1, math.ceil(least * n - 1e-9)), int(n / least + 1e-9) + 1):
        k = math.ceil(least * (n + m) / (1 + least) - 1e-9)
        if k > min(n, m):
            continue
        p = 0.0
        for s, at in chances(k):
            one, two = (sum(c for x, c in chances(size - k) if s + x > 0) for size in (n, m))
            p += at * (one * (1 - two) + two * (1 - one))
        worst = max(worst, p)
    return worst


@lru_cache(maxsize=None)
def tables(least: float, n: int, bits: int) -> int:
    """How many sections of `bits` bits a set of n values needs, so that MISS of its near sets share none within one bit."""
    p = differing(least, n)
    return math.ceil(math.log(MISS) / math.log1p(-((1 - p) ** bits + bits * p * (1 - p) ** (bits - 1))))


def section_bits(rows: int) -> int:
    """Even, and growing with the number of rows, so that a section's value is shared by few unlike texts."""
    return min(30, max(16, (rows.bit_length() - 1) // 2 * 2))


def sections(values: np.ndarray, least: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The WHOLE first words of the wide fingerprint of a set that is not empty, and its sections."""
    count = tables(least, min(len(values), 41), bits)
    flat = wide_fingerprint(values, max(WHOLE, -(-count * bits // BITS)))
    return np.packbits(flat[: WHOLE * BITS]).view(np.uint64), flat[: count * bits].reshape(count, bits) @ (1 << np.arange(bits, dtype=np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """df with `out`: the fingerprint as a signed BIGINT of the same 64 bits. Null, empty and wordless texts: 0.

    keep_text=False leaves the text out of the result, so that it does not travel back from Python.
    """
    df = df.select(*(c for c in df.columns if c.lower() != out.lower()))
    kept = [c for c in df.columns if keep_text or c != text]
    schema = ", ".join([*([df.select(*kept)._jdf.schema().toDDL()] if kept else []), f"`{out}` bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("simhash", _CACHE.clear)
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], names=[*kept, out])

    return df.mapInArrow(work, schema)


def trie_pairs(a: np.ndarray, b: np.ndarray, same: bool, bit: int, differing: int, budget: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of two sorted uint64 arrays with at most `budget` differing bits.

    Both arrays share their bits above `bit` apart from `differing` ones. A node is a range [lo, hi) of its array; the
    frontier of node pairs goes one bit deeper at a time, depth first in blocks of `most` pairs, so memory is bounded.
    """
    if not len(a) or not len(b):
        return
    stack = [(bit, np.array([[0, len(a), 0, len(b), differing]], np.int64))]
    while stack:
        bit, front = stack.pop()
        if bit == 0:
            # Distinct values: a node at full depth is one element.
            i, j = front[:, 0], front[:, 2]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        bit -= 1
        mask = np.uint64(1 << bit)
        halves = []
        for values, lo, hi in ((a, front[:, 0], front[:, 1]), (b, front[:, 2], front[:, 3])):
            # Ones before each index: the split of a node is where its bit turns from 0 to 1.
            halves.append(hi - _ones(values, mask, bit, lo, hi))
        children = []
        for x in (0, 1):
            al, ah = (front[:, 0], halves[0]) if x == 0 else (halves[0], front[:, 1])
            for y in (0, 1):
                bl, bh = (front[:, 2], halves[1]) if y == 0 else (halves[1], front[:, 3])
                d = front[:, 4] + (x ^ y)
                keep = (al < ah) & (bl < bh) & (d <= budget)
                if same:
                    keep &= al <= bl  # of a pair of nodes and its mirror image one is enough
                if keep.any():
                    children.append(np.stack([al, ah, bl, bh, d], axis=1)[keep])
        if children:
            front = np.concatenate(children)
            stack += [(bit, front[at : at + most]) for at in range(0, len(front), most)]


_CACHE: dict = {}


def _ones(values: np.ndarray, mask: np.uint64, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    key = (id(values), bit)
    if key not in _CACHE:
        if len(_CACHE) > 2 * BITS:
            _CACHE.clear()
        _CACHE[key] = (values, np.concatenate([[0], np.cumsum((values & mask) != 0)]))
    sums = _CACHE[key][1]
    return sums[hi] - sums[lo]


def _forest(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Union-find over index pairs; the links that joined two sets."""
    parent = np.arange(len(ids))
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        while True:  # all roots at once, for whole arrays
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        apart = parent[i] != parent[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((int(ids[x]), int(ids[y])))
    return out


def near_links(prints: DataFrame, column: str = "fingerprint", budget: int = 3, prefix: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever is connected by at most `budget` differing bits.

    `prints` holds distinct BIGINT fingerprints. Each goes to the subtrie pairs that its first `prefix` bits can form
    within the budget (42 with 6 bits). By default the prefix grows with the number of fingerprints, so that a subtrie
    holds about 2**15 of them.
    """
    if prefix is None:
        prefix = min(20, max(6, prints.count().bit_length() - 15))
    n = 1 << prefix
    masks = [m for k in range(budget + 1) for bits in combinations(range(prefix), k) for m in [sum(1 << b for b in bits)]]
    top = F.shiftrightunsigned(F.col(column), BITS - prefix)
    pairs = F.transform(F.array(*(F.lit(m).cast("bigint") for m in masks)), lambda m: F.least(F.col("p"), F.col("p").bitwiseXOR(m)) * n + F.greatest(F.col("p"), F.col("p").bitwiseXOR(m)))
    dealt = prints.select(F.col(column).alias("f"), top.alias("p")).select("f", "p", F.explode(pairs).alias("pair"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        holds("simhash", _CACHE.clear)
        p, q = divmod(key[0].as_py(), n)
        values = table.column("f").to_numpy().astype(np.int64).view(np.uint64)
        own = table.column("p").to_numpy()
        a = np.sort(values[own == p])
        b = a if p == q else np.sort(values[own == q])
        ids = a if p == q else np.concatenate([a, b])
        shift = 0 if p == q else len(a)
        found = ((i, j + shift) for i, j in trie_pairs(a, b, p == q, BITS - prefix, bin(p ^ q).count("1"), budget))
        links = np.array(_forest(ids.view(np.int64), found), np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return dealt.groupBy("pair").applyInArrow(join, "a bigint, b bigint")


class _Sets:
    """Union-find over whole arrays; a set's root is its smallest index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            p, q = self.parent[i], self.parent[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            self.parent[high] = np.minimum(p, q)[first]
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


def _products(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the ranges [a, a + n) and [b, b + m), at most `most` at a time."""
    ends = np.cumsum(n * m)
    for low in range(0, int(ends[-1]) if len(ends) else 0, most):
        flat = np.arange(low, min(low + most, int(ends[-1])))
        of = np.repeat(*_spans(ends, low, int(flat[-1]) + 1))
        rest = flat - (ends[of] - n[of] * m[of])
        yield a[of] + rest // m[of], b[of] + rest % m[of]


def _spans(ends: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.searchsorted(ends, [low, high - 1], "right")
    edges = np.concatenate([[low], ends[first:last], [high]])
    return np.arange(first, last + 1), np.diff(edges)


def near_sets(section: np.ndarray, whole: np.ndarray, bit: int, only: int = 0, within: tuple[int, ...] = WITHIN, pivots: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(root, mates) of each row: the first row of its component, and how many of that have its section value.

    Rows are linked if their sections differ in at most one of the lowest `bit` bits (and, of different sections, in one of
    `only` where that is given) and their first words of `whole` in at most `within`. A trie join of the section values
    gives pairs of leaves. The rows of a leaf are first compared with a few of them, so a dense cluster is one component
    before pairs are looked at; then only rows of different components are compared.
    """
    order = np.argsort(section, kind="stable")
    values, start, size = np.unique(section[order], return_index=True, return_counts=True)
    values = values.astype(np.uint64)
    u, v = (np.concatenate(x) for x in zip(*trie_pairs(values, values, True, bit, 0, 1), (np.zeros(0, np.int64),) * 2, strict=True))
    if only:
        meant = ((values[u] ^ values[v]) & np.uint64(only)) != 0
        u, v = u[meant], v[meant]
    words = [np.ascontiguousarray(whole[order, k]) for k in range(whole.shape[1])]
    sets = _Sets(len(section))

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        bits = np.zeros(len(i), np.uint8)
        for word, most in zip(words, within, strict=True):
            bits += np.bitwise_count(word[i] ^ word[j])
            near = np.flatnonzero(bits <= most)
            i, j, bits = i[near], j[near], bits[near]
        if len(i):
            sets.join(i, j)

    leaf = np.repeat(np.arange(len(values)), size)
    for k in range(pivots):
        pivot = start + size * k // pivots
        compare(pivot[leaf], np.arange(len(order)))
        compare(pivot[u], pivot[v])
    # A run is the rows of one leaf and one component; rows of a run need no comparison.
    ranked = np.lexsort((sets.parent, leaf))
    order, words = order[ranked], [word[ranked] for word in words]
    place = np.empty(len(order), np.int64)
    place[ranked] = np.arange(len(order))
    roots = place[sets.parent[ranked]]
    at = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (roots[1:] != roots[:-1])]))
    sets = _Sets(len(order))
    sets.join(np.arange(len(order)), roots)
    long = np.diff(np.append(at, len(order)))
    runs = np.bincount(leaf[at], minlength=len(values))
    first = np.cumsum(runs) - runs
    own = np.flatnonzero(runs > 1) if not only else np.zeros(0, np.int64)
    u, v = np.concatenate([u, own]), np.concatenate([v, own])
    for i, j in _products(first[u], runs[u], first[v], runs[v]):
        parent = sets.parent[at]
        other = np.flatnonzero((i != j) & (parent[i] != parent[j]))
        i, j = i[other], j[other]
        several = long[i] * long[j] > 1
        compare(at[i[~several]], at[j[~several]])
        i, j = i[several], j[several]
        for x, y in _products(at[i], long[i], at[j], long[j]):
            compare(x, y)
    least = np.full(len(order), len(order))
    np.minimum.at(least, sets.parent, order)
    root = np.empty(len(order), np.int64)
    root[order] = least[sets.parent]
    _, same, mates = np.unique(section * len(section) + root, return_inverse=True, return_counts=True)
    return root, mates[same]


def wide_links(prints: DataFrame, bits: int, rows: int, group: int = 13) -> DataFrame:
    """(a, b, reach): links between rows (node, whole, sections) that connect all that wide fingerprints call near; rows
    with a null b tell how many rows of its component node a shares a section's value with.

    A table's rows are dealt by the leading bits of the section, about 2**group together. Sections that differ in a leading
    bit meet in a second rotation of the table, which begins with the section's other half and makes only those pairs.
    """
    g = min(bits // 2, max(0, rows.bit_length() - group))
    half = bits // 2
    low = (1 << half) - 1
    turned = F.shiftleft(F.col("s").bitwiseAND(low), half).bitwiseOR(F.shiftright("s", half))
    dealt = prints.select("node", F.col("whole"), F.posexplode("sections").alias("t", "s"))
    if g:
        dealt = dealt.select("node", "whole", F.col("t"), F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("s").alias("s")), F.struct(F.lit(1).alias("r"), turned.alias("s")))).alias("x")).select("node", "whole", "t", "x.r", "x.s")
    else:
        dealt = dealt.select("node", "whole", "t", F.lit(0).alias("r"), "s")
    key = F.shiftleft(F.col("t").cast("bigint") * 2 + F.col("r"), g).bitwiseOR(F.shiftright("s", bits - g).cast("bigint"))
    only = ((1 << g) - 1) << (half - g)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        holds("simhash", _CACHE.clear)
        table = table.sort_by("node").combine_chunks()
        node, section = table.column("node").to_numpy(), table.column("s").to_numpy().astype(np.int64)
        whole = np.frombuffer(b"".join(x.as_py() for x in table.column("whole")), np.uint64).reshape(-1, WHOLE)
        of = key[0].as_py() >> g
        root, mates = near_sets(section, whole, bits - g, only if of % 2 else 0)
        _CACHE.clear()
        linked = np.flatnonzero(root != np.arange(len(root)))
        told = np.flatnonzero(mates > 1) if of % 2 == 0 and of < 32 else np.zeros(0, np.int64)
        b = pa.concat_arrays([pa.array(node[linked]), pa.nulls(len(told), pa.int64())])
        reach = np.concatenate([np.zeros(len(linked), np.int64), mates[told]])
        return pa.table({"a": np.concatenate([node[root[linked]], node[told]]), "b": b, "reach": reach})

    return dealt.select(key.alias("key"), "node", "whole", "s").groupBy("key").applyInArrow(join, "a bigint, b bigint, reach bigint")


def _grouped(df: DataFrame, key: str, text: str, budget: int, shingle: int, prefix: int | None) -> DataFrame:
    """(key, h, h2, fingerprint, group, component_id) of every row; h and h2 are hashes of the text, group is never null."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = spread(df.select(F.col(key).alias("key"), F.xxhash64(own).alias("h"), F.hash(own).alias("h2"), F.col(text).alias("text")))
    marked = written(with_fingerprint(rows, "text", "fingerprint", shingle, keep_text=False), "prints")
    prints = written(marked.groupBy("fingerprint").agg(F.min("key").alias("least")), "prints")
    groups = components(near_links(prints, "fingerprint", budget, prefix))
    grouped = prints.join(groups, prints.fingerprint == groups.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "group").select("fingerprint", "group", "component_id")
    return marked.join(ids, "fingerprint").select("key", "h", "h2", "fingerprint", "group", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3, shingle: int = 3, prefix: int | None = None) -> DataFrame:
    """df with `fingerprint` (BIGINT) and `component_id`: the smallest non-null key of the documents it is linked with, over
    any number of links, itself included.

    Equal fingerprints (copies, empty and null texts with fingerprint zero) are one node, so copies are never expanded
    into pairs. Rows keep their number and order of columns; rows with a null key take part, and a component of null keys
    only has a null id. Columns of df named fingerprint or component_id are replaced. Empty tables give empty ones.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in ("fingerprint", "component_id")))
    return _grouped(df, key, text, budget, shingle, prefix).select(F.col("key").alias(key), "fingerprint", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """One row of each group: the one with the smallest key (of rows with that key, one); a null key only if the group has no other."""
    return keep_one(df, _grouped(df, key, text, budget, 3, None), key, text)
