"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

Documents are read once into a forward index of the query terms alone (document, terms, occurrences), from which the corpus
numbers and each term's weight come. Each task then takes its part of the index shard by shard: a shard's postings are
sorted by impact for each term, an item's lists are read round-robin, and every document met is scored at once from its row
of the forward index. What no list has shown yet scores at most the sum of the impacts last read; reading stops when that
threshold is strictly below the score of the k-th best, which is carried from shard to shard. So ties of the k-th are all
seen. A task gives at most k documents an item; the best k of those are the result, as each shard's best hold the corpus's.

Items are taken in blocks of bounded text, which are broadcast; a larger query set makes more passes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandfold.llm.common import spread, written

#: Terms: ASCII letters and digits and all other characters beyond ASCII; bytes beyond 7F are those of the latter.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, only A-Z lower-cased."""
    return TERM.findall((text or "").encode().lower())


def forward_index(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs): a row a document; n counts all its terms, the arrays hold only those in `numbers`."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    kind = to_arrow_type(docs.schema[key].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            sizes, terms, tfs = [], [], []
            for t in batch.column("text"):
                found = terms_of(t.as_py())
                sizes.append(len(found))
                own = [(known[x], n) for x, n in Counter(found).items() if x in known]
                terms.append([x for x, _ in own])
                tfs.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(kind), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["key", "n", "terms", "tfs"])

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(work, f"key {docs.schema[key].dataType.simpleString()}, n bigint, terms array<int>, tfs array<bigint>")


class Shard:
    """A part of the forward index as flat arrays, and its postings sorted by term and falling impact."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.ends, self.terms, self.impacts = ends, terms, impacts
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((owner, -impacts, terms))
        self.docs, self.falling = owner[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.met = np.zeros(len(ends) - 1, bool)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Random access: the whole score of each document from its own row; weights are the item's terms with repeats."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[docs] - begin, sizes)
        return np.add.reduceat(self.impacts[at] * weights[self.terms[at]], begin)

    def search(self, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, least: int, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the k best of the shard with a score of at least `least`, ties of the k-th included.

        The lists are read `step` positions a round. least: what a document must reach to be among the k best so far."""
        begin, end = self.lists[terms], self.lists[terms + 1]
        found, scored, depth = [], [], 0
        while True:
            inside = begin + depth < end
            read = [self.docs[b : min(b + step, e)] for b, e in zip(begin[inside] + depth, end[inside], strict=True)]
            if not read:
                break
            some = np.unique(np.concatenate(read))
            some = some[~self.met[some]]
            self.met[some] = True
            if len(some):
                found.append(some)
                scored.append(self.scores(some, weights))
                if sum(map(len, scored)) >= k:
                    every = np.concatenate(scored)
                    least = max(least, int(np.partition(every, len(every) - k)[len(every) - k]))
            depth += step
            more = begin + depth <= end  # the list had the position last read
            threshold = int((self.falling[np.minimum(begin + depth, end)[more] - 1] * times[more]).sum())
            if threshold < least or not threshold:
                break
        docs = np.concatenate(found) if found else np.zeros(0, np.int64)
        scores = np.concatenate(scored) if scored else np.zeros(0, np.int64)
        self.met[docs] = False
        return docs[scores >= max(least, 1)], scores[scores >= max(least, 1)]


def _best(rows: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The k first of (score, key): larger scores, then smaller keys, null keys last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]


def _top(index: DataFrame, items: list[Counter], weights: np.ndarray, n: int, total: int, k: int, shard_rows: int) -> DataFrame:
    """(item, key, score): each task's k best documents of every item. items: occurrences of term numbers."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))
    kind = to_arrow_type(index.schema["key"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        ready = []
        for item in items:
            own = np.array(sorted(item), np.int64)
            times = np.array([item[t] for t in own], np.int64)
            ready.append((own, times))
        of_item = np.zeros(len(weights), np.int64)
        best: list[list] = [[] for _ in items]
        for batch in (b.slice(at, shard_rows) for b in batches for at in range(0, b.num_rows, shard_rows)):
            keys = batch.column("key")
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            terms = lists.flatten().to_numpy().astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy()
            m = 75 + 25 * batch.column("n").to_numpy() * n // max(total, 1)
            shard = Shard(ends, terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))), len(weights))
            for i, (own, times) in enumerate(ready):
                of_item[own] = times
                least = best[i][-1][0] if len(best[i]) == k else 1
                docs, scores = shard.search(own, times, of_item, least, k)
                of_item[own] = 0
                if len(docs):
                    best[i] = _best(best[i] + [(int(s), keys[int(d)].as_py()) for d, s in zip(docs, scores, strict=True)], k)
        rows = [(i, key, s) for i, some in enumerate(best) for s, key in some]
        for at in range(0, len(rows), 4096):
            own = list(zip(*rows[at : at + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], kind), pa.array(own[2], pa.int64())], names=["item", "key", "score"])

    return index.select("key", "n", "terms", "tfs").mapInArrow(work, f"item bigint, key {index.schema['key'].dataType.simpleString()}, score bigint")


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items and their terms, streamed to the driver in blocks of about `block_bytes` of terms."""
    block, size = [], 0
    for r in items.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        own = Counter(terms_of(r["text"]))
        block.append((r["item"], own))
        size += sum(len(x) + 16 for x in own) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20, block_bytes: int = 8 << 20, shard_rows: int = 8192) -> DataFrame:
    """(item, rank, key, score): the k documents of highest score for each item, ranked from 1; equal scores by ascending key,
    null keys last. Scores are whole numbers: a term of weight w = floor(1000 ln((2N + 2) / (2 df + 1))) that stands tf times
    in a document of n terms gives w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, for each time the item has it.

    N counts the documents with a term, L all their terms. Null and empty texts have no term; an item without terms, or
    whose terms no document holds, gives no rows. Repeated rows are documents, or items, of their own; other columns are
    ignored; an empty table on either side gives no rows. Names of the output that clash are told apart by `item`, `key`.
    """
    spark = docs.sparkSession
    names = [item, "rank", key if key.lower() != item.lower() else "key", "score"]
    kinds = items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    parts = []
    for block in _blocks(items, item, item_text, block_bytes):
        numbers = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        index = written(forward_index(docs, numbers, key, text), "index")
        n, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row for each term of the block.
        df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        rated = df.select("term", F.floor(1000 * F.ln((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint").alias("w")).collect()
        weights = np.zeros(len(numbers), np.int64)
        for r in rated:
            weights[r["term"]] = r["w"]
        found = _top(index, [Counter({numbers[t]: c for t, c in own.items()}) for _, own in block], weights, n, total, k, shard_rows)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        # A limit on the rank is applied within each task before rows move.
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        told = F.broadcast(spark.createDataFrame([(i, own) for i, (own, _) in enumerate(block)], f"item bigint, id {kinds[0]}"))
        parts.append(best.join(told, "item").select(F.col("id").alias(names[0]), "rank", F.col("key").alias(names[2]), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{names[0]}` {kinds[0]}, rank int, `{names[2]}` {kinds[1]}, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
