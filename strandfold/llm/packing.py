"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to partitions at random; each task takes its documents in groups of bounded size and packs each group
on its own, so nothing is gathered and a group's memory is bounded whatever the input. A document longer than a sequence
gives full sequences and one remainder; only remainders compete for space.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import holds

#: A space before a character that is no white space begins a pre-token of the byte-level pattern whatever stands before it,
#: so texts may be cut there and each cut tokenised by itself.
_CUT = re.compile(r" (?=\S)")
#: Without one of these, every space is a cut.
_ODD = re.compile(r" (?:\s|$)")


class TournamentTree:
    """Bins in order of opening, each inner node the largest free capacity below it: first fit in O(log bins)."""

    def __init__(self, size: int, capacity: int) -> None:
        self.leaves = 1 << max(0, size - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with room for `need`, which it takes."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        free[node] -= need
        at = node >> 1
        while at:
            free[at] = max(free[2 * at], free[2 * at + 1])
            at >>= 1
        return node - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each size, number of bins); every size is at most `capacity`. Ties keep their order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tree = TournamentTree(max(1, len(sizes)), capacity)
    bins = [0] * len(sizes)
    for i in order:
        bins[i] = tree.place(sizes[i])
    return bins, max(bins, default=-1) + 1


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes out of a text before anything else."""
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


#: Ids of words seen, each as it is after a space. Bounded: emptied when full, and long words are not kept.
_WORDS: dict[str, bytes] = {}
_MOST_WORDS, _LONGEST = 500_000, 64


#: Characters on whose class (letter, number, white space, other) all Unicode versions agree.
_STABLE = re.compile(r"[\n\x21-\x7e\u00a1-\u024f]+")


@cache
def _ranked(path: str):
    """The tokenizer's own vocabulary as a rank-merging encoder, several times faster on new words; None unless its merges
    are its ids in order, byte-level, with the usual pattern and nothing before or after, so that ids must be equal."""
    import tiktoken

    with open(path) as f:
        made = json.load(f)
    model, pre = made["model"], made["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or made["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or len({vocab[c] for c in byte_of} & set(range(256))) != 256:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _learn(words: list[str], path: str) -> None:
    tokenizer, ranked = _tokenizer(path), _ranked(path)
    for w in words:
        if ranked and _STABLE.fullmatch(w):
            ids = ranked.encode_ordinary(" " + w)
        else:
            ids = tokenizer.encode(" " + w, add_special_tokens=False).ids
        _WORDS[w] = array("I", ids).tobytes()


def _release() -> None:
    _WORDS.clear()
    _tokenizer.cache_clear()
    _special.cache_clear()
    _ranked.cache_clear()


def encode_group(texts: list[str], path: str, last: int, chars: int = 1 << 20) -> list[bytes]:
    """encode() of about `chars` characters at a time, so that only their words exist at once."""
    holds("packing", _release)
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < chars:
            size += len(texts[end])
            end += 1
        out += encode(texts[at:end], path, last)
        at = end
    return out


def encode(texts: list[str], path: str, last: int) -> list[bytes]:
    """Each text's ids and then `last`, little-endian uint32."""
    tokenizer, end = _tokenizer(path), np.array([last], "<u4").tobytes()
    alone = lambda s: np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    if len(_WORDS) > _MOST_WORDS:
        _WORDS.clear()
    # A text that holds one of the tokenizer's own special strings is not cut: such strings may reach over spaces.
    cuts = [[t] if any(x in t for x in _special(path)) else _CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
    new: set[str] = set()
    for c in cuts:
        new.update(c[1:])
    _learn([w for w in new if w not in _WORDS and len(w) <= _LONGEST], path)
    out = []
    for first, *rest in cuts:
        got = list(map(_WORDS.get, rest))
        if None in got:
            got = [alone(" " + w) if x is None else x for w, x in zip(rest, got, strict=True)]
        out.append(b"".join([alone(first), *got, end]))
    return out


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, last: int = 0, group_docs: int = 2048, group_chars: int = 8 << 20, partitions: int | None = None) -> DataFrame:
    """One row per piece: `key`, start, length, doc_tokens, sequence_id, offset, ids (BINARY, little-endian uint32).

    A document is its token ids and then `last`; a null or empty text is `last` alone. Every id lies in exactly one piece.
    sequence_id is the partition and the number of the sequence in it; offsets are gapless from 0. A group ends at
    `group_docs` documents or `group_chars` characters. Special strings of the tokenizer (such as its end-of-text mark) give
    their own ids where they stand in a text, as the tokenizer itself does without add_special_tokens. Repeated rows and null keys are documents like any other; other
    columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Dealt by row, not by key: equal rows and null keys spread as well. Sorted by what deals them, so that a task that is
    # run again after its input was fetched in another order makes the same groups and sequences.
    dealt = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    dealt = dealt.repartition(n, "deal").sortWithinPartitions("deal").select("key", "text")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        keys, texts, chars = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column("key"), batch.column("text"), strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py())
                chars += len(texts[-1])
                if len(keys) >= group_docs or chars >= group_chars:
                    yield keys, texts
                    keys, texts, chars = [], [], 0
        if keys:
            yield keys, texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = None, None
        base, used = TaskContext.get().partitionId() << 36, 0
        for keys, texts in groups(batches):
            ids = encode_group(texts, tokenizer, last)
            totals = [len(x) // 4 for x in ids]
            rests = [i for i, n in enumerate(totals) if n % capacity]
            bins, opened = first_fit_decreasing([totals[i] % capacity for i in rests], capacity)
            full_base, filled, rows = used + opened, [0] * opened, []
            for i, n in enumerate(totals):
                for k in range(n // capacity):
                    rows.append((keys[i], k * capacity, capacity, n, base + full_base, 0, ids[i][4 * k * capacity : 4 * (k + 1) * capacity]))
                    full_base += 1
            for i, b in zip(rests, bins, strict=True):
                size = totals[i] % capacity
                rows.append((keys[i], totals[i] - size, size, totals[i], base + used + b, filled[b], ids[i][4 * (totals[i] - size) :]))
                filled[b] += size
            used = full_base
            columns = list(zip(*rows, strict=True))
            for at in range(0, len(rows), 4096):
                names = names or ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                types = types or [None, *[pa.int64()] * 5, pa.binary()]
                arrays = [pa.array(c[at : at + 4096], t) if t is not None else pa.array(c[at : at + 4096], batch_type) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, *names[1:]])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(df.schema[key].dataType)
    return dealt.mapInArrow(work, schema)
