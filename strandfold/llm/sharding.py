"""Histogram sort into shards of near-equal bytes.

A row's key is 63 bits: a hash of its text above a hash of its id, so equal texts are neighbours and a group too large for
one shard can still be cut. Exact bytes and rows below evenly spaced probe keys are counted over all partitions at once;
an interval that holds a splitter and more than the tolerance is probed again, until splitters are within tolerance or the
interval is a single key. Then rows move once, to slices of bounded size and known first slot; only the table of slice
bounds grows with the data, by one row for each `slice_bytes`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm.common import fresh, spread, written

KEY_BITS, STEP = 63, 12


def _counts(keyed: DataFrame, intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first key, width in bits, bytes, rows) of the non-empty sub-intervals of disjoint intervals (first key, bits, bits
    to refine by)."""
    starts, widths, down = (np.array(c, np.int64) for c in zip(*intervals, strict=True))
    inner = np.maximum(widths - down, 0)

    @F.pandas_udf("bigint")
    def probe(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        at = np.searchsorted(starts, k, "right") - 1
        safe = np.maximum(at, 0)
        inside = (at >= 0) & ((k - starts[safe]) >> widths[safe] == 0)
        return pd.Series(np.where(inside, starts[safe] + ((k - starts[safe]) >> inner[safe] << inner[safe]), -1))

    found = keyed.groupBy(probe("key").alias("at")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).where("at >= 0").toPandas()
    which = np.searchsorted(starts, found["at"].to_numpy(np.int64), "right") - 1
    return sorted(zip(found["at"].tolist(), inner[which].tolist(), found["b"].tolist(), found["n"].tolist(), strict=True))


def histogram(keyed: DataFrame, shards: int, tolerance: float, slice_bytes: int) -> list[tuple[int, int, int, int]]:
    """Exact (first key, bits, bytes, rows) of disjoint intervals over all keys. Refined until no interval that holds a
    splitter has more than `tolerance` of a shard's bytes, and none has more than a slice's, unless it is one key."""
    cells = _counts(keyed, [(0, KEY_BITS, STEP)])
    total = sum(c[2] for c in cells)
    while True:
        kept, split, below = [], [], 0
        for c in cells:
            cuts = (below + c[2]) * shards // total > below * shards // total if total else False
            wide = c[2] > slice_bytes or cuts and c[2] * shards > tolerance * total
            (split if wide and c[1] else kept).append(c)
            below += c[2]
        if not split:
            return cells
        # As fine as four cells a slice, and all the way where a splitter must be found.
        fine = lambda b: min(STEP, max(1, (4 * b // slice_bytes).bit_length()))
        cuts = {c[0] for c in split if c[2] <= slice_bytes}
        cells = sorted(kept + _counts(keyed, [(at, w, STEP if at in cuts else fine(b)) for at, w, b, _ in split]))


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.002, slice_bytes: int = 64 << 20) -> DataFrame:
    """df with size (UTF-8 bytes of the text plus 1, null: 1), shard (0 to shards-1) and slot (gapless from 0 in a shard).

    Law: bytes. Splitters are exact to `tolerance` of a shard's share, or to one key's rows. Equal texts are neighbours and
    lie in one shard, unless a splitter falls among them. Rows keep their columns; columns named size, shard or slot are
    replaced. Null ids and repeated rows are rows like any other: rows of null ids and one text are told apart by a hash of
    their other columns (maps aside), so only rows that are equal in all of them have one key. An empty table gives an
    empty one. What is gathered is
    one row for each non-empty probe: about four for each `slice_bytes` of the data, and 2**12 for each splitter and round.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in ("size", "shard", "slot")))
    k, s, first = fresh(df, "key_", "slice_", "first_")
    # 40 bits of the text's hash, 23 bits of the id's, or of the whole row's where there is no id.
    row = F.xxhash64(*(F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()))
    own_id = F.when(F.col(key).isNull(), row).otherwise(F.xxhash64(F.col(key)))
    own = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 24), 23).bitwiseOR(F.shiftrightunsigned(own_id, 41))
    sized = df.withColumns({"size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint"), k: own})
    keyed = written(spread(df).select(own.alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size")), "keys")
    cells = histogram(keyed, shards, tolerance, slice_bytes)
    total = sum(c[2] for c in cells)

    # Splitters nearest to equal shares, then slices: runs of cells within a shard.
    starts, shard_of, slot_of, below, rows = [], [], [], 0, [0] * shards
    size_here = 0
    for at, _, b, n in cells:
        to = min(shards - 1, int((below + b / 2) * shards / total))
        to = max(to, shard_of[-1] if shard_of else 0)
        if not starts or to != shard_of[-1] or size_here + b > slice_bytes:
            starts.append(at)
            shard_of.append(to)
            slot_of.append(rows[to])
            size_here = 0
        size_here += b
        rows[to] += n
        below += b
    bounds = np.array(starts or [0], np.int64)
    bounds[0] = 0

    of, base = np.array(shard_of or [0], np.int32), np.array(slot_of or [0], np.int64)

    @F.pandas_udf("slice int, shard int, base bigint")
    def place(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(bounds, keys.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"slice": at.astype(np.int32), "shard": of[at], "base": base[at]})

    moved = sized.withColumn(s, place(k))
    order = Window.partitionBy(F.col(s)["slice"]).orderBy(k, F.col(key).asc_nulls_first())
    out = moved.withColumn(first, F.row_number().over(order).cast("bigint") - 1)
    return out.select(*df.columns, "size", F.col(s)["shard"].alias("shard"), (F.col(first) + F.col(s)["base"]).alias("slot"))
