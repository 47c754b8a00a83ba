"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

Both tokenizers begin a token at a single space between two characters that are no white space, so texts are cut there and
each different word is aligned once in a task. A task files what it links under the side id, the A id: posting blocks (B id,
document, times) and, summed before anything moves, count blocks (B id, documents). Blocks are dealt by side id and sorted,
count blocks first, so a task streams through sorted, spillable rows: it adds up an id's counts, knows their maximum, then
gives each document's part from the postings behind them. Parts are summed by document. An id with many postings is split
into slices, each of which gets the id's count blocks, which are bounded by B's vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandfold.llm.common import fresh, holds, spread, written
from strandfold.llm.packing import _STABLE, _ranked, _tokenizer

#: White space that is no plain space, to any Unicode version.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if (chr(c).isspace() or c == 0x180E) and chr(c) != " "]
_SPACE = frozenset([" ", *_OTHER_SPACE])
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


def _words(text: str) -> list[str]:
    """The text cut at each single space between two characters that are no white space."""
    odd = "  " in text or text[0] in _SPACE or text[-1] in _SPACE or any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACE)
    return _CUT.split(text) if odd else text.split(" ")


@cache
def _piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _token_bytes_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    tokenizer = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]


@cache
def _token_bytes_b(path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    model = _piece_model(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in names]


@cache
def _pieces_stay_apart(path: str) -> bool:
    """Whether no piece of B reaches over a space that follows something else, so that texts may be cut there."""
    return not any(b" " in t.lstrip(b" ") for t in _token_bytes_b(path))


class _Flat:
    """A growing array of int64."""

    def __init__(self) -> None:
        self.data, self.size = np.zeros(1 << 16, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(self.size + len(more), np.int64)])
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Aligner:
    """Words aligned once; numbers of words index flat arrays. Emptied by the caller when it holds `most` words."""

    def __init__(self, a_path: str, b_path: str, most: int = 250_000) -> None:
        self.a_path, self.b_path, self.most = a_path, b_path, most
        self.bytes_of = _token_bytes_a(a_path), _token_bytes_b(b_path)
        self.lengths = tuple(np.array([len(t) for t in own], np.int64) for own in self.bytes_of)
        names = [str(i) for i in range(max(map(len, self.bytes_of)))]
        self.told = {c: [n + c for n in names] for c in ",|;\n"}  # ids with what follows them
        self.by_words = _pieces_stay_apart(b_path) and _ranked(a_path) is not None
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        #: Tokens of A (-1: no alignment), of B, groups, links of each word; links of all words as a << 32 | b.
        self.sizes, self.pairs = [_Flat() for _ in range(4)], _Flat()

    def _ids_a(self, words: list[str]) -> list[list[int]]:
        ranked, tokenizer = _ranked(self.a_path), _tokenizer(self.a_path)
        plain = ranked.encode_ordinary if ranked else None
        tokenizer.encode_special_tokens = True
        try:
            return [plain(" " + w) if plain and _STABLE.fullmatch(w) else tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
        finally:
            tokenizer.encode_special_tokens = False

    def learn(self, words: list[str]) -> None:
        """Align words that are not known yet, all at once: their bytes lie one after the other, so ends of tokens that
        both sides have are ends of groups, and the B tokens that an A token overlaps follow from sorted ends."""
        ids = self._ids_a(words), _piece_model(self.b_path).encode(words)
        wholes = [(" " + w).encode() for w in words]
        for side, own in enumerate(ids):
            if b"".join([self.bytes_of[side][x] for w in own for x in w]) != b"".join(wholes):
                for i, w in enumerate(own):
                    if b"".join([self.bytes_of[side][x] for x in w]) != wholes[i]:
                        ids[0][i], ids[1][i] = [], []
        n_a, n_b = (np.array([len(w) for w in own], np.int64) for own in ids)
        a, b = (np.array([x for w in own for x in w], np.int64) for own in ids)
        word_a, word_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        group_ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(group_ends, end_a), np.searchsorted(group_ends, end_b)
        last_of_group = np.searchsorted(end_a, group_ends)
        n_groups = np.bincount(word_a[last_of_group], minlength=len(words))
        first = np.searchsorted(end_b, end_a - self.lengths[0][a], "right")
        n = np.searchsorted(end_b - self.lengths[1][b], end_a) - first
        linked = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        self.pairs.add(np.repeat(a, n) << 32 | b[linked])
        n_links = np.bincount(word_a, n, len(words)).astype(np.int64)
        for own, more in zip(self.sizes, (np.where(n_a > 0, n_a, -1), n_b, n_groups, n_links), strict=True):
            own.add(more)
        # Ids in the order they are told in, each with what follows: within a side, between sides, groups and words.
        order = np.lexsort((np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]), np.concatenate([group_a, group_b])))
        ids_told, of_b = np.concatenate([a, b])[order], order >= len(a)
        group, word = np.concatenate([group_a, group_b])[order], np.concatenate([word_a, word_b])[order]
        ends = lambda x: np.append(x[1:] != x[:-1], True)
        follows = np.where(ends(word), 3, np.where(ends(group), 2, np.where(ends(of_b), 1, 0))) if len(order) else np.zeros(0, np.int64)
        tables = [self.told[c] for c in ",|;\n"]
        told = iter("".join([tables[f][i] for f, i in zip(follows.tolist(), ids_told.tolist(), strict=True)]).split("\n"))
        self.texts += [next(told) if k else "" for k in n_a.tolist()]
        for w in words:
            self.numbers[w] = len(self.numbers)

    def batch(self, texts: list[str | None], digest: bool) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, groups, a, b, document, times) of some texts: per text the four sizes and the groups, or their digest;
        the different links of each text with their number, sorted by a, b, document."""
        parts = [[] if not t else _words(t) if self.by_words else [t] for t in texts]
        words = [list(map(self.numbers.get, own)) for own in parts]
        new = list(dict.fromkeys(w for own, got in zip(parts, words, strict=True) if None in got for w, x in zip(own, got, strict=True) if x is None))
        for at in range(0, len(new), 1 << 14):
            self.learn(new[at : at + (1 << 14)])
        words = [list(map(self.numbers.__getitem__, own)) if None in got else got for own, got in zip(parts, words, strict=True)]
        lengths = np.array([len(w) for w in words])
        flat = np.fromiter(chain.from_iterable(words), np.int64, int(lengths.sum()))
        sizes = [own.view() for own in self.sizes]
        owner = np.repeat(np.arange(len(texts)), lengths)
        bad = np.zeros(len(texts), bool)
        bad[owner[sizes[0][flat] < 0]] = True
        per = np.stack([np.bincount(owner, own[flat], len(texts)).astype(np.int64) for own in sizes], axis=1)
        per[bad] = 0
        told = ["" if bad[i] or not w else ";".join([self.texts[x] for x in w]) for i, w in enumerate(words)]
        if digest:
            told = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
        keep = ~bad[owner]
        unit, times = np.unique(owner[keep] << 32 | flat[keep], return_counts=True)
        owner, flat = unit >> 32, unit & 0xFFFFFFFF
        n = sizes[3][flat]
        begin = (np.cumsum(sizes[3]) - sizes[3])[flat]
        at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        pairs = self.pairs.view()[at]
        # a in the upper 24 bits, b in 24, the text in 16.
        keys = ((pairs >> 32) << 40) | ((pairs & 0xFFFFFFFF) << 16) | np.repeat(owner, n)
        order = np.argsort(keys)
        keys, many = keys[order], np.repeat(times, n)[order]
        new = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, np.int64)
        many = np.add.reduceat(many, new) if len(keys) else many
        keys = keys[new]
        return per, told, keys >> 40, keys >> 16 & 0xFFFFFF, keys & 0xFFFF, many


_MADE = "kind tinyint, uid bigint, key {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, a int, n int, b binary, doc binary, times binary"
_DOCUMENT, _COUNTS, _POSTINGS = 0, 1, 2


def _blobs(values: np.ndarray, ends: np.ndarray, kind: str = "<u4") -> pa.Array:
    """Values as little-endian integers, cut at `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((np.dtype(kind).itemsize * ends).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _values(blobs: pa.Array) -> np.ndarray:
    """All uint32 of the blobs, one after the other."""
    return np.frombuffer(b"".join(x for x in blobs.to_pylist() if x is not None), "<u4")


def _runs(a: np.ndarray, most: int) -> np.ndarray:
    """Where blocks of one id and at most `most` entries begin, and the end."""
    begin = np.flatnonzero(np.append(True, np.diff(a) != 0)) if len(a) else np.zeros(0, np.int64)
    ends = np.append(begin, len(a))
    return np.unique(np.concatenate([ends, *(np.arange(b, e, most) for b, e in zip(begin, ends[1:], strict=True) if e - b > most)])).astype(np.int64)


class _Made:
    """Record batches of the one table that a pass over the documents writes."""

    def __init__(self, key_type: pa.DataType) -> None:
        self.types = [pa.int8(), pa.int64(), key_type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        self.names = [c.split()[0] for c in _MADE.split(", ")]

    def of(self, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in zip(self.names, self.types, strict=True)], names=self.names)

    def blocks(self, kind: int, base: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray | None, times: np.ndarray, most: int = 1024) -> Iterator[pa.RecordBatch]:
        cuts = _runs(a, most)
        for at in range(0, len(cuts) - 1, 2048):
            ends = cuts[at : at + 2049]
            n, own, part = len(ends) - 1, slice(ends[0], ends[-1]), ends - ends[0]
            more = {} if doc is None else {"doc": _blobs(doc[own], part)}
            yield self.of(n, kind=pa.array(np.full(n, kind, np.int8)), uid=pa.array(np.full(n, base)), a=pa.array(a[ends[:-1]]), n=pa.array(np.diff(ends)), b=_blobs(b[own], part), times=_blobs(times[own], part), **more)


def _align_all(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, digest: bool, chars: int) -> DataFrame:
    """Documents with their sizes and groups, posting blocks and count blocks, told apart by `kind`; uid numbers the rows."""
    kind = to_arrow_type(docs.schema[key].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def release() -> None:
            for f in (_piece_model, _token_bytes_a, _token_bytes_b, _ranked, _tokenizer):
                f.cache_clear()

        holds("align", release)
        aligner, made, uid = Aligner(a_path, b_path), _Made(kind), TaskContext.get().partitionId() << 36
        sums: list[tuple[np.ndarray, np.ndarray]] = []  # (a << 24 | b, documents)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*sums, strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            new = np.flatnonzero(np.append(True, np.diff(keys) != 0))
            return keys[new], np.add.reduceat(n, new)

        for keys, texts in _groups(batches, chars):
            if len(aligner.numbers) > aligner.most:
                aligner.clear()
            per, told, a, b, doc, times = aligner.batch(texts, digest)
            n = len(texts)
            columns = {c: pa.array(per[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield made.of(n, kind=pa.array(np.full(n, _DOCUMENT, np.int8)), uid=pa.array(uid + np.arange(n)), key=pa.array(keys, kind), groups=pa.array(told, pa.string()), **columns)
            if len(a):
                yield from made.blocks(_POSTINGS, uid, a, b, doc, times)
                ab = a << 24 | b
                new = np.flatnonzero(np.append(True, np.diff(ab) != 0))
                sums.append((ab[new], np.diff(np.append(new, len(ab)))))
                if sum(len(k) for k, _ in sums) > 1 << 21:
                    sums[:] = [summed()]
                    if len(sums[0][0]) > 1 << 20:
                        (k, m) = sums.pop()
                        yield from made.blocks(_COUNTS, 0, k >> 24, k & 0xFFFFFF, None, m)
            uid += n
        if sums:
            k, m = summed()
            yield from made.blocks(_COUNTS, 0, k >> 24, k & 0xFFFFFF, None, m)

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(work, _MADE.format(key=docs.schema[key].dataType.simpleString()))


def _groups(batches: Iterator[pa.RecordBatch], chars: int, most: int = 1 << 16) -> Iterator[tuple[list, list[str | None]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column("key"), batch.column("text"), strict=True):
            keys.append(k.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "") + 64
            if size >= chars or len(texts) == most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _contributions(blocks: DataFrame) -> DataFrame:
    """(base, doc, hit, total) from blocks in order of (a, slice, kind): what the links of a task add to the documents
    numbered from `base`, summed by document; there are at most as many entries as postings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best = None, np.zeros(1, np.int64), -1
        out: list[tuple[np.ndarray, ...]] = []

        def told() -> pa.RecordBatch:
            base, doc, hit, total = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            order = np.argsort(base + doc, kind="stable")
            base, doc = base[order], doc[order]
            new = np.flatnonzero(np.append(True, np.diff(base + doc) != 0))
            base, doc, hit, total = base[new], doc[new], np.add.reduceat(hit[order], new), np.add.reduceat(total[order], new)
            ends = np.append(np.flatnonzero(np.append(True, np.diff(base) != 0)), len(base))
            return pa.RecordBatch.from_arrays([pa.array(base[ends[:-1]]), _blobs(doc, ends), _blobs(hit, ends, "<i8"), _blobs(total, ends, "<i8")], names=["base", "doc", "hit", "total"])

        for batch in batches:
            a, part, kind, uid, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "slice", "kind", "uid", "n"))
            b, times = (_values(batch.column(c)).astype(np.int64) for c in ("b", "times"))
            doc = _values(batch.column("doc"))
            ends = np.concatenate([[0], np.cumsum(n)])
            posted = np.concatenate([[0], np.cumsum(np.where(kind == _POSTINGS, n, 0))])
            cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(a)] if len(a) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now != (a[lo], part[lo]):
                    now, best = (a[lo], part[lo]), -1
                    counts[:] = 0
                own = b[ends[lo] : ends[hi]]
                if len(counts) <= own.max():
                    counts = np.concatenate([counts, np.zeros(int(own.max()) + 1, np.int64)])
                many = times[ends[lo] : ends[hi]]
                if kind[lo] == _COUNTS:
                    np.add.at(counts, own, many)
                    continue
                if best < 0:
                    best = int(counts.max())
                c = counts[own]
                out.append((np.repeat(uid[lo:hi], n[lo:hi]), doc[posted[lo] : posted[hi]].astype(np.int64), many * (c == best), many * c))
                if sum(len(x[0]) for x in out) > 1 << 20:
                    yield told()
        if out:
            yield told()

    return blocks.mapInArrow(work, "base bigint, doc binary, hit binary, total binary")


def _by_document(parts: DataFrame) -> DataFrame:
    """(uid, n_best, count_sum): the sums of all parts (base, doc, hit, total), a row a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, met = None, np.zeros((2, 0), np.int64), np.zeros(0, bool)

        def told() -> pa.RecordBatch:
            doc = np.flatnonzero(met)
            return pa.RecordBatch.from_arrays([pa.array(now + doc), pa.array(sums[0, doc]), pa.array(sums[1, doc])], names=["uid", "n_best", "count_sum"])

        for batch in batches:
            for base, doc, *more in zip(*(batch.column(c) for c in ("base", "doc", "hit", "total")), strict=True):
                if base.as_py() != now:
                    if now is not None:
                        yield told()
                    now, sums, met = base.as_py(), np.zeros((2, 1 << 16), np.int64), np.zeros(1 << 16, bool)
                own = np.frombuffer(doc.as_py(), "<u4")
                met[own] = True
                for k, x in enumerate(more):
                    sums[k, own] += np.frombuffer(x.as_py(), "<i8")  # a document stands once in a part
        if now is not None:
            yield told()

    return parts.repartition("base").sortWithinPartitions("base").mapInArrow(work, "uid bigint, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a_tokenizer: str, b_model: str, key: str = "doc_id", text: str = "text", digest: bool = False, most: int = 1 << 18, chars: int = 2 << 20) -> DataFrame:
    """One row per document: `key`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A is a byte-level `tokenizers` file, encoding a space and the text; B a sentencepiece model, which adds the space itself.
    groups lists `a1,a2|b1;a3|b2,b3`, decimal ids in order (digest: its SHA-256 in hex, and '' for no groups). A link is an
    A and a B token whose bytes overlap; an id pair's count is the number of documents that hold it linked; n_best are the
    links whose count is the highest of their A id, count_sum adds the counts over all links.

    Null and empty texts, and texts that either side does not spell byte by byte, have no tokens: zeros and ''. Special
    strings in texts are plain text. Repeated rows and null keys are documents of their own, other columns are ignored, an
    empty table gives no rows. most: entries of an A id's postings beyond which they are split among tasks. What the pass
    over the documents makes is one table in the shared folder.
    """
    made = written(_align_all(docs, a_tokenizer, b_model, key, text, digest, chars), "aligned")
    by_id = made.where(F.col("kind") == _POSTINGS).groupBy("a").agg(F.ceil(F.sum("n") / most).cast("int").alias("slices"))
    # At most a row for each id of A's vocabulary.
    blocks = made.where(F.col("kind") != _DOCUMENT).select("a", "kind", "uid", "n", "b", "doc", "times").join(F.broadcast(by_id), "a")
    # A block of postings goes to one slice, a block of counts to all slices of its id.
    one = F.when(F.col("kind") == _POSTINGS, F.array(F.pmod(F.xxhash64("uid", F.crc32("b")), F.col("slices")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = blocks.select("a", "kind", "uid", "n", "b", "doc", "times", F.explode(one).alias("slice")).repartition("a", "slice").sortWithinPartitions("a", "slice", "kind")
    sums = _by_document(_contributions(dealt))
    own = made.where(F.col("kind") == _DOCUMENT).select("uid", "key", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = F.lit(0).cast("bigint")
    (name,) = fresh(made.select("n_a", "n_b", "n_groups", "n_links", "groups"), key)
    return own.join(sums, "uid", "left").select(F.col("key").alias(name), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")
