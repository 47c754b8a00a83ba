"""Best-fit packing: whole documents into as few sequences as possible.

Large-item matching: pieces above a third of the capacity lie at most two in a sequence, matched greedily, the largest with
the largest that fits beside it; smaller pieces then go, largest first, to the sequence where they leave the least room.

Lengths are whole numbers up to the capacity. The plan therefore needs only how many pieces have each length, at most
`capacity` numbers however large the corpus, and is made for the corpus as a whole, not group by group. A piece then finds
its place by its rank among the pieces of its length: ranks are counted within each written part and shifted by the counts
of the parts before, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandfold.llm.common import fresh, holds, spread, written
from strandfold.llm.packing import _special, _tokenizer

#: (length, first rank, pieces, first sequence, pieces in each sequence, offset of the first)
Segment = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Where the pieces of each length go, and the number of sequences, from the number of pieces of each length.

    Runs of sequences with one content are handled at once, so the steps follow the number of lengths, not of pieces.
    """
    left, taken, segments, sequences = dict(counts), Counter(), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, number) of sequences with just that room
    rooms: list[int] = []

    def put(size: int, n: int, sequence: int, each: int, offset: int) -> None:
        segments.append((size, taken[size], n, sequence, each, offset))
        taken[size] += n
        left[size] -= n

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not gaps[room]:
                insort(rooms, room)
            gaps[room].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, min(a, capacity - a)) - 1
        if at >= 0 and large[at] == a and left[a] == 1:
            at -= 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b == a:
            put(a, 2 * n, sequences, 2, 0)
        else:
            put(a, n, sequences, 1, 0)
            if b is not None:
                put(b, n, sequences, 1, a)
        leave(capacity - a - (b or 0), sequences, n)
        sequences += n
        for s in {a, b}:
            if s is not None and not left[s]:
                large.pop(bisect_left(large, s))
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                opened = -(-left[s] // (capacity // s))
                leave(capacity, sequences, opened)
                sequences += opened
                continue
            room = rooms[at]
            first, n = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(at)
            # A sequence stays the tightest one for this length until it has no room for one more.
            each = room // s
            filled, over = divmod(min(left[s], each * n), each)
            put(s, filled * each + over, first, each, capacity - room)
            leave(room - each * s, first, filled)
            leave(room - over * s, first + filled, int(over > 0))
            leave(room, first + filled + (over > 0), n - filled - (over > 0))
    return segments, sequences


# The pattern that a tokenizer file must have for words to be taken apart here, and the same classes for the
# characters of _PLAIN in lower case.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Texts whose white space, case and composed form nobody sees differently; others are left to the tokenizer as a whole.
_PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*")
_WORDS: dict[str, bytes] = {}
_MOST_WORDS, _LONGEST = 400_000, 64


@cache
def _word_model(path: str):
    """A rank-merging encoder of parts that each end in a zero byte, which stands for the mark of a word's end; several
    times faster on new words than the tokenizer. None unless the file's merges are its ids in order and its words are
    what lies between white space, in lower case, taken apart by the pattern above."""
    import tiktoken

    with open(path) as f:
        made = json.load(f)
    model = made["model"]
    normal = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    first, *then = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    same = first.get("pattern") == {"Regex": _FILE_PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
    bytes_only = [x["type"] for x in then] == ["ByteLevel"] and not then[0]["add_prefix_space"] and not then[0]["use_regex"]
    if normal != ["NFC", "Replace", "Lowercase"] or not same or not bytes_only or made["post_processor"] or model.get("dropout") or model.get("ignore_merges"):
        return None
    mark, vocab = model["end_of_word_suffix"], model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if not mark or any(vocab[x + y] != 512 + i for i, (x, y) in enumerate(merges)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte_of[c] for c in t.removesuffix(mark)) + b"\0" * t.endswith(mark): i for t, i in vocab.items() if i < 512 + len(merges)}
    ranks[b"\0"] = 512 + len(merges)  # never alone: no part is empty
    return tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


def _release() -> None:
    _WORDS.clear()
    for f in (_tokenizer, _special, _word_model):
        f.cache_clear()


def _word_ids(word: str, path: str) -> bytes:
    return array("I", _word_model(path).encode_ordinary("\0".join([*_PART.findall(word), ""]))).tobytes()


def encode(texts: list[str], path: str, last: int) -> list[bytes]:
    """Each text's ids and then `last`, little-endian uint32: what the tokenizer gives without adding special tokens."""
    holds("bestfit", _release)
    end, out = np.array([last], "<u4").tobytes(), []
    by_words, special = _word_model(path) is not None, _special(path)
    for text in texts:
        if not by_words or not _PLAIN.fullmatch(text) or any(x in text for x in special):
            out.append(np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end)
            continue
        words = text.lower().split()
        got = list(map(_WORDS.get, words))
        if None in got:
            if len(_WORDS) > _MOST_WORDS:
                _WORDS.clear()
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    got[i] = _WORDS.get(w) or _word_ids(w, path)
                    if len(w) <= _LONGEST:
                        _WORDS[w] = got[i]
        got.append(end)
        out.append(b"".join(got))
    return out


def cut_pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, last: int = 0) -> DataFrame:
    """(key, piece, start, length, ids, part, nth): each document's ids in pieces of `capacity`, the last perhaps shorter;
    nth counts the pieces of one length within the part that a task makes. Store it before use: parts are those of a run."""
    kind = to_arrow_type(df.schema[key].dataType)
    names = ["key", "piece", "start", "length", "ids", "part", "nth"]
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows = []
            for k, ids in zip(batch.column("key").to_pylist(), encode(batch.column("text").to_pylist(), tokenizer, last), strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append((k, piece, at // 4, size, own, part, seen[size]))
                    seen[size] += 1
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), types, strict=True)], names=names)

    rows = spread(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return rows.mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary, part bigint, nth bigint")


def pack_best_fit(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, last: int = 0) -> DataFrame:
    """One row per piece: `key`, piece, start, length, ids (BINARY, little-endian uint32), sequence_id, offset.

    A document is its token ids and then `last`; a null or empty text is `last` alone. Only documents longer than `capacity`
    are cut. sequence_id counts from 0 without gaps, and so do the offsets of a sequence; which of the pieces of one length
    goes where follows the parts that the tokens were written in. Special strings of the tokenizer give their own ids where
    they stand in a text. Repeated rows and null keys are documents like any other; other columns are ignored; an empty
    table gives no rows. The tokens are a table in the shared folder.
    """
    spark = df.sparkSession
    pieces = written(cut_pieces(df, tokenizer, key, text, capacity, last), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    size, first, n, sequence, each, offset = fresh(pieces, "size_", "first_", "n_", "sequence_", "each_", "offset_")
    # A few rows for each length, so at most a small multiple of `capacity`.
    places = F.broadcast(spark.createDataFrame(segments, ", ".join(f"{c} bigint" for c in (size, first, n, sequence, each, offset))))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("nth")
    found = pieces.join(shift, ["part", "length"]).join(places, (F.col("length") == F.col(size)) & (rank >= F.col(first)) & (rank < F.col(first) + F.col(n)))
    nth = rank - F.col(first)
    at = F.col(sequence) + F.floor(nth / F.col(each))
    return found.select(F.col("key").alias(key), "piece", "start", "length", "ids", at.cast("bigint").alias("sequence_id"), (F.col(offset) + nth % F.col(each) * F.col(size)).alias("offset"))
