"""Nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node, so a vector that a third of all rows share costs as much as any other. The graph starts from
neighbours in sorted random-projection codes and is improved by joins of neighbours of neighbours: every node's neighbours
and reverse neighbours meet in one row group, new pairs among them are scored, and each member keeps its best. Queries
walk the graph: a beam of the best nodes found is expanded by joins until nothing in it is left to expand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm.common import discard, fresh, written


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed in the order of the components. Vectors whose squares would leave the range of doubles are
    divided by their largest component first; others are taken as they are."""

    def ranged(x: Column) -> Column:
        most = F.array_max(F.transform(x, lambda c: F.abs(c.cast("double"))))
        return F.when(most.between(1e-100, 1e100), x).otherwise(F.transform(x, lambda c: c.cast("double") / most))

    a, b = ranged(a), ranged(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors (float32) of a column of coded()."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(vectors: DataFrame, vector: str) -> DataFrame:
    """(node, unit): the vector's components as float32 shares of its largest one, which is what travels between joins;
    results are scored on the original vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(vector):
                x = v.values.to_numpy(zero_copy_only=False)
                rows.append((x / np.abs(x).max()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.binary())], names=["node", "unit"])

    return vectors.select("node", vector).mapInArrow(work, "node bigint, unit binary")


def _scored(pairs: DataFrame) -> DataFrame:
    """(q, node, sim) of pairs (q, node, q_unit, unit)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sim = np.einsum("ij,ij->i", _matrix(batch.column("q_unit")), _matrix(batch.column("unit")))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(sim.astype(np.float32))], names=["q", "node", "sim"])

    return pairs.select("q", "node", "q_unit", "unit").mapInArrow(work, "q bigint, node bigint, sim float")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of `size` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, size).to_batches()[0]
            held = whole.slice(size).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(nbr), pa.array(sim.astype(np.float32))], names=["node", "nbr", "sim"])


def _first_edges(nodes: DataFrame, k: int, tables: int, block: int, seed: int) -> DataFrame:
    """Each node's best in blocks of consecutive rows, sorted by sign codes of random projections; several tables."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("unit"))
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], 24)).astype(np.float32)
                codes = ((x @ planes > 0) * (1 << np.arange(23, -1, -1))).sum(axis=1) + (t << 24)
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), *batch.columns], names=["code", "node", "unit"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, block):
            x, ids = _matrix(part.column("unit")), part.column("node").to_numpy()
            table = part.column("code").to_numpy() >> 24
            s = x @ x.T
            s[(ids[:, None] == ids[None, :]) | (table[:, None] != table[None, :])] = -2
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            sim = np.take_along_axis(s, top, axis=1)
            keep = sim > -2
            yield _edges(np.repeat(ids, keep.sum(axis=1)), ids[top[keep]], sim[keep])

    sorted_codes = nodes.mapInArrow(code, "code bigint, node bigint, unit binary")
    n = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted_codes.repartitionByRange(n, "code", F.xxhash64("node")).sortWithinPartitions("code", F.xxhash64("node")).mapInArrow(best, "node bigint, nbr bigint, sim float")


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node: (node, nbrs array<struct<sim,nbr,fresh>>); an edge is fresh if all its rows are."""
    own = edges.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = F.sort_array(F.collect_list(F.struct("sim", (-F.col("nbr")).alias("minus"), "nbr", "fresh")), asc=False)
    return own.groupBy("node").agg(F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["sim"], x["nbr"], x["fresh"])).alias("nbrs"))


def _both_ways(graph: DataFrame, k: int) -> DataFrame:
    """(node, nbr, fresh): neighbours and the k nearest of the reverse neighbours."""
    forward = graph.select("node", F.explode("nbrs").alias("e")).select("node", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"), F.col("e.fresh").alias("fresh"))
    back = forward.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "fresh")
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    return forward.union(back).groupBy("node", "nbr").agg(F.max("fresh").alias("fresh"))


def _joined_locally(graph: DataFrame, nodes: DataFrame, k: int, each: int = 4) -> DataFrame:
    """One round of neighbours of neighbours: (node, nbr, sim) of new pairs better than the node's worst neighbour."""
    worst = graph.select(F.col("node").alias("nbr"), F.element_at("nbrs", -1)["sim"].alias("worst"))
    members = _both_ways(graph, k).join(nodes.withColumnRenamed("node", "nbr"), "nbr").join(worst, "nbr")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            groups = held.column("node").to_numpy()
            if not len(groups):
                continue
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
            if cut:
                yield from score(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from score(held)

    def score(table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = table.column("node").to_numpy()
        x = _matrix(table.column("unit"))
        ids, new, floor = table.column("nbr").to_numpy(), table.column("fresh").to_numpy(), table.column("worst").to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2 or not new[a:b].any():
                continue
            s = x[a:b] @ x[a:b].T
            good = (s > floor[a:b, None]) & (new[a:b, None] | new[None, a:b])
            np.fill_diagonal(good, False)
            # Each member's best few of this group; others come from its other groups or in a later round.
            s = np.where(good, s, -2)
            j = np.argsort(-s, axis=1, kind="stable")[:, :each]
            i = np.repeat(np.arange(b - a), j.shape[1])
            j = j.ravel()
            i, j = i[s[i, j] > -2], j[s[i, j] > -2]
            out.append((ids[a + i], ids[a + j], s[i, j]))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    n = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.select("node", "nbr", "fresh", "worst", "unit").repartition(n, "node").sortWithinPartitions("node")
    return dealt.mapInArrow(pairs, "node bigint, nbr bigint, sim float")


def build_graph(nodes: DataFrame, k: int = 32, rounds: int = 6, tables: int = 8, block: int = 512, seed: int = 5, least_change: float = 0.01) -> DataFrame:
    """NN-descent over nodes (node, unit): (node, nbrs array<struct<sim,nbr,fresh>>), best first, as a written table.

    Ends after `rounds`, or when a round changes less than `least_change` of all edges.
    """
    graph = written(_merged(_first_edges(nodes, max(1, k // 2), tables, block, seed).withColumn("fresh", F.lit(True)), k), "graph")
    total = max(1, graph.select(F.sum(F.size("nbrs"))).first()[0] or 0)
    for _ in range(rounds):
        old = graph.select("node", F.explode("nbrs").alias("e")).select("node", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"), F.lit(False).alias("fresh"))
        found = _joined_locally(graph, nodes, k).withColumn("fresh", F.lit(True))
        following = written(_merged(old.union(found), k), "graph")
        discard(graph)
        graph = following
        changed = graph.select(F.sum(F.size(F.filter("nbrs", lambda e: e["fresh"])))).first()[0] or 0
        if changed < least_change * total:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, beam: int = 160, k: int = 32) -> DataFrame:
    """(q, node, sim): the beam of each query (q, start, unit) after greedy search from the node `start`.

    Each step expands all nodes of the beam that are not expanded yet; the search ends when no beam has any.
    That comes about, for a beam only gets better and what has left it does not come back.
    """
    links = written(_both_ways(graph, k).groupBy("node").agg(F.collect_list("nbr").alias("nbrs")), "links")
    asked = written(queries.select("q", "start", F.col("unit").alias("q_unit")), "asked")
    first = _scored(asked.select("q", F.col("start").alias("node"), "q_unit").join(nodes, "node")).withColumn("done", F.lit(False))
    state = written(first, "beam")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    while True:
        frontier = state.where("not done").select("q", "node")
        found = frontier.join(links, "node").select("q", F.explode("nbrs").alias("node")).distinct().join(state.select("q", "node"), ["q", "node"], "left_anti")
        scored = _scored(found.join(nodes, "node").join(asked, "q")).withColumn("done", F.lit(False))
        both = state.withColumn("done", F.lit(True)).union(scored)
        following = written(both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r"), "beam")
        discard(state)
        state = following
        if not state.where("not done").limit(1).count():
            break
    return state.select("q", "node", "sim")


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 5, k: int = 32, beam: int = 160) -> DataFrame:
    """(query_id, rank, key, score): the `top` nearest by cosine of every row for which is_query holds, found among all
    other rows; ranks from 1, ties to the smaller key.

    Vectors that are null, zero or hold null or non-finite components, rows with a null key, and vectors of another length
    than the most common one take no part, neither as queries nor as candidates. Repeated rows with one key and vector count once;
    a key with several vectors asks with each of them and is found by the nearest, once. Fewer candidates than `top` give fewer ranks; an empty table gives none.
    """
    names = fresh(df, "is_query_")
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias(names[0]))
    # Adding zero turns -0.0 into 0.0, so that equal vectors are equal bytes.
    rows = rows.select("id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v"), F.col(names[0]).alias("asks"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score double")
    rows = rows.where(F.size("v") == lengths[0]["n"])
    groups = rows.groupBy("v").agg(F.min("id").alias("node"))
    vectors = written(groups, "vectors")
    nodes = written(coded(vectors, "v"), "nodes")
    members = written(rows.join(vectors.select("v", "node"), "v").select("id", "node", "asks").groupBy("id", "node").agg(F.max("asks").alias("asks")), "members")
    asking = members.where("asks").select("node").distinct()
    graph = build_graph(nodes, k)
    found = search(asking.join(nodes, "node").select(F.col("node").alias("q"), F.col("node").alias("start"), "unit"), graph, nodes, beam, k=k)
    # Exact scores of the whole beam on the original vectors; of equal vectors the smallest keys can be enough.
    best = found.select("q", "node")
    scored = best.join(vectors.select("node", "v"), "node").join(vectors.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").select("q", "node", cosine(F.col("qv"), F.col("v")).alias("score"))
    by_id = Window.partitionBy("node").orderBy("id")
    few = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= top + 1).select("id", "node")
    near = scored.join(few, "node").select("q", F.col("id").alias("found"), "score")
    final = Window.partitionBy("q").orderBy(F.desc("score"), "found")
    near = near.withColumn("r", F.row_number().over(final)).where(F.col("r") <= top + 1).select("q", "found", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    pairs = members.where("asks").select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(near, "q").where("found != query_id")
    pairs = pairs.groupBy("query_id", "found").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("found").alias(key), "score")
