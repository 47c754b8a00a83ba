"""Near copies by the SimHash fingerprints of their word shingles: a trie join proposes, the shingle sets decide.

Texts with one shingle set are one node. Nodes get wide SimHash fingerprints, of so many sections that a pair of the least
similarity is lost with a probability of 1e-6; simhash.wide_links() joins them in tries. Nodes that it connects, over any
number of links, are one bucket. First each is compared with two of its bucket: the node that shares its sections with the
most others, which in a group of near copies is the text they were made from, and the smallest one. Then the nodes of
buckets that still hold different components are
compared in blocks of bounded size: a task counts the shingles that all sets of two blocks share by a product of matrices
and gives a spanning forest of the links, so no pair becomes a row; a component of more than a block is not compared with
itself. A bucket of more than a block is not compared as it is: its nodes are dealt anew by the rarest shingles that they
share with other components, so unlike texts of one bucket do not meet. A pair is a link if the Jaccard similarity of the
two sets reaches the least one, counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm.common import components, keep_one, spread, written
from strandfold.llm.simhash import _forest, section_bits, sections, wide_links, words_of

#: A block's expected weight: its nodes' shingles, and LONE more for each node, which bounds the nodes of a block as well.
BLOCK, LONE = 1 << 18, 128


def shingles_of(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the runs of `size` words; fewer words are one run, no word gives none."""
    words = words_of(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [" ".join(words)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(s) for s in runs), np.uint64))


def _marked(texts: DataFrame, size: int, least: float, bits: int) -> DataFrame:
    """(key, h, h2, node, n, whole, sections) of rows (key, h, h2, text): the set's hash, its size, its wide fingerprint."""
    schema = f"{texts.select('key', 'h', 'h2')._jdf.schema().toDDL()}, node bigint, n int, whole binary, sections array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py(), size) for t in batch.column("text")]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = [sections(s, least, bits) if len(s) else (None, None) for s in sets]
            whole = pa.array([None if w is None else w.tobytes() for w, _ in prints], pa.binary())
            parts = pa.array([None if p is None else p.astype(np.int32) for _, p in prints], pa.list_(pa.int32()))
            columns = [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), whole, parts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "h", "h2")), *columns], names=["key", "h", "h2", "node", "n", "whole", "sections"])

    return texts.mapInArrow(work, schema)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py(), size).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(work, "node bigint, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= least * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return held.select("a", "b", "sa", "sb").mapInArrow(work, "a bigint, b bigint")


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """The number of values that each of the sets `rows` shares with each of the sets `columns`."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = np.bincount(at) > 1
    at, owner = (np.cumsum(several) - 1)[at[several[at]]], owner[several[at]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    width = max(1, cells // len(sets))
    for low in range(0, int(several.sum()), width):
        i, j = np.searchsorted(at, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[i:j], at[i:j] - low] = 1
        out += has[rows] @ has[columns].T
    return out


def _by_rarest(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (band, node, w, c) of light buckets, and the nodes of those heavier than BLOCK in buckets of a shingle each.

    Two sets of different components that are similar enough share at least ceil(least * n) shingles, n being the larger
    size, and each of these is held by several components. So of the s such shingles of a set, in one order for all sets,
    the first s - ceil(least * n) + 1 hold the first of what the two share: they meet in its bucket, whatever the order.
    With the rarest first, buckets are small unless texts are alike in what is rare. Buckets of one component are left out.
    """
    parts = rest.groupBy("band", "c").agg(F.sum("w").alias("w"))
    several = written(parts.groupBy("band").agg(F.sum("w").alias("all"), F.count("*").alias("parts")).where("parts > 1"), "several")
    light = rest.join(several.where(F.col("all") <= BLOCK).select("band"), "band", "left_semi")
    heavy = rest.join(several.where(F.col("all") > BLOCK).select("band"), "band", "left_semi").select("node", "w", "c").distinct()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, held in enumerate(batch.column("shingles")):
                shingles = np.frombuffer(held.as_buffer(), np.int64)
                at = np.full(len(shingles), i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("node", "w", "c")), pa.array(shingles)], names=["node", "w", "c", "shingle"])

    held = written(heavy.join(sets, "node").mapInArrow(each, "node bigint, w bigint, c bigint, shingle bigint"), "shingles")
    shared = held.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2").select("shingle", "holders")
    own = Window.partitionBy("node")
    placed = held.join(shared, "shingle").select("*", F.row_number().over(own.orderBy("holders", "shingle")).alias("place"), F.count("*").over(own).alias("s"))
    wanted = F.col("s") - F.ceil(F.lit(least) * (F.col("w") - LONE) - 1e-9) + 1
    dealt = placed.where(F.col("place") <= wanted).select(F.xxhash64("shingle").alias("band"), "node", "w", "c")
    return light.select("band", "node", "w", "c").unionByName(dealt)


def _linked_in_blocks(buckets: DataFrame, found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the different components of each bucket's nodes, as a forest of each pair of blocks.

    The hub and the lead of a bucket have been compared with all of it. Of the others, a component heavier than BLOCK has
    blocks of its own, which are not compared with each other; the rest of the bucket is one class. Buckets heavier than
    BLOCK are first dealt anew by _by_rarest().
    """
    rest = buckets.where("node != hub and node != lead").join(found, "node", "left")
    rest = written(rest.select("band", "node", (F.col("n") + LONE).cast("bigint").alias("w"), F.coalesce("component", "node").alias("c")), "rest")
    rest = written(_by_rarest(rest, sets, least), "rest")
    parts = rest.groupBy("band", "c").agg(F.sum("w").alias("w"))
    several = parts.groupBy("band").agg(F.count("*").alias("parts")).where("parts > 1").select("band")
    parts = parts.join(several, "band").select("band", "c", "w", F.when(F.col("w") > BLOCK, F.col("c")).alias("own"))
    classes = written(parts.groupBy("band", "own").agg(F.ceil(F.sum("w") / BLOCK).alias("blocks")), "classes")
    block = lambda number: F.xxhash64("band", F.coalesce("own", F.lit(0)), F.col("own").isNull(), number)
    of_class = [F.col("p.band") == F.col("k.band"), F.col("p.own").eqNullSafe(F.col("k.own"))]
    dealt = parts.alias("p").join(classes.alias("k"), of_class).select("p.band", "p.c", "p.own", "k.blocks")
    dealt = rest.join(dealt, ["band", "c"]).select(block(F.pmod(F.xxhash64("node"), "blocks")).alias("block"), "node", "c")
    every = classes.select("band", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("i")).select("band", "own", block(F.col("i")).alias("block"))
    one, two = every.select("band", F.col("own").alias("own1"), F.col("block").alias("x")), every.select("band", F.col("own").alias("own2"), F.col("block").alias("y"))
    pairs = one.join(two, "band").where("x <= y and (own1 is null or own2 is null or own1 != own2)").select("x", "y")
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = sides.join(dealt, "block").join(sets, "node").select("x", "y", "block", "node", "c", "shingles")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        ids, c, of = (table.column(name).to_numpy() for name in ("node", "c", "block"))
        held = [np.frombuffer(s.as_buffer(), np.uint64) for chunk in table.column("shingles").chunks for s in chunk]
        n = np.array([len(s) for s in held], np.float64)
        rows, columns = np.flatnonzero(of == x), np.flatnonzero(of == y)
        links = np.zeros((0, 2), np.int64)
        if len(rows) and len(columns):
            both = _shared(held, rows, columns)
            like = (both >= least * (n[rows, None] + n[None, columns] - both) - 1e-9) & (c[rows, None] != c[None, columns])
            i, j = np.nonzero(like)
            links = np.array(_forest(ids, iter([(rows[i], columns[j])])), np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return rows.groupBy("x", "y").applyInArrow(compare, "a bigint, b bigint")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(key, h, h2, group) of every row of df: its key, the two hashes of its text, and the component of its text among
    texts linked by a similarity of at least `least`, over any number of links.

    Texts without words (null and empty ones too) are one group.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    texts = spread(df.select(F.col(key).alias("key"), F.xxhash64(own).alias("h"), F.hash(own).alias("h2"), own.alias("text")))
    rows = df.count()
    bits = section_bits(rows)
    marked = written(_marked(texts, size, least, bits), "marked")
    prints = [F.first(c).alias(c) for c in ("n", "whole", "sections")]
    nodes = marked.where("sections is not null").groupBy("node").agg(*prints, F.min(F.struct("h", "h2")).alias("at"))
    nodes = written(nodes, "nodes")
    met = written(wide_links(nodes, bits, nodes.count()), "met")
    reach = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("reach").alias("reach"))
    near = components(met.where("b is not null").select("a", "b")).select("node", F.col("component").alias("band"))
    near = written(near.join(reach, "node", "left").join(nodes.select("node", "n"), "node").select("band", "node", "n", F.coalesce("reach", F.lit(0)).alias("reach")), "near")
    leads = near.groupBy("band").agg(F.max(F.struct("reach", "node"))["node"].alias("hub"), F.min("node").alias("lead"))
    buckets = written(near.drop("reach").join(leads, "band"), "buckets")
    # Sets are made again for those that share a bucket, from one text each.
    wanted = buckets.select("node").distinct().join(nodes.select("node", "at.h", "at.h2"), "node")
    sets = written(_sets(texts.join(wanted, ["h", "h2"]).dropDuplicates(["node"]), size), "sets")
    pair = lambda x: buckets.where(F.col("node") != F.col(x)).select(F.least("node", x).alias("a"), F.greatest("node", x).alias("b"))
    tried = written(pair("hub").union(pair("lead")).distinct(), "tried")
    links = written(_linked(tried, sets, least), "linked")
    found = components(links)
    found = components(links.union(written(_linked_in_blocks(buckets, found, sets, least), "linked")))
    return marked.join(found, "node", "left").select("key", "h", "h2", F.coalesce("component", "node").alias("group"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the one with the smallest key, a null key only if the group has no other."""
    return keep_one(df, near_copies(df, key, text, size, least), key, text)
