"""Helpers that several operators share: the shared folder, written tables, Arrow text buffers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="strandfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WRITTEN: list[DataFrame] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, gives Catalyst true sizes.

    Results of operators read such tables when they are used; discard_written() deletes what is left of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _WRITTEN.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x is not df]


def discard_written() -> None:
    """Delete all tables of written() that are left; for callers that have used or stored the results of operators."""
    for df in list(_WRITTEN):
        discard(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of df's (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out if the scanned files are smaller than one split for each core, so that every core has rows.

    What is moved is thereby less than cores times maxPartitionBytes; sizes come from the plan, so nothing is run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(2 * cores) if scanned < cores * split else df


def running_spans(pieces: Column, value: str, block: int = 512) -> Column:
    """array<struct<start,end,value>> of the kept pieces of an array<struct<skip,size,keep,value>>: a piece starts `skip`
    after the end of the one before. Long arrays are walked in blocks, for appending to an array copies it."""
    kind = f"array<struct<start:bigint,end:bigint,value:{value}>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + x["size"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def walked(some: Column) -> Column:
        return F.aggregate(some, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found")), step)

    last = F.floor((F.size(pieces) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: walked(F.slice(pieces, b * block + 1, F.lit(block))))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = F.zip_with(F.slice(before, F.lit(1), last + 1), blocks, lambda o, x: F.transform(x["found"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"))))
    return F.when(F.size(pieces) <= block, walked(pieces)["found"]).otherwise(F.flatten(moved))


def keep_one(df: DataFrame, grouped: DataFrame, key: str, text: str) -> DataFrame:
    """One row of df for each group: the one with the smallest key, nulls last, then the smallest text hash; of rows with
    the same key and text, one.

    `grouped` has a row (key, h, h2, group) for every row of df, h and h2 being xxhash64 and hash of the text, and rows of
    one text are in one group.
    """
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h", "h2")).alias("best"))
    k, h, h2, a, b = fresh(df, "key_", "h_", "h2_", "own_h_", "own_h2_")
    wanted = best.select(F.col("best.key").alias(k), F.col("best.h").alias(h), F.col("best.h2").alias(h2))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({a: F.xxhash64(whole), b: F.hash(whole)})
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(a) == F.col(h)) & (F.col(b) == F.col(h2))
    return rows.join(wanted, same, "left_semi").dropDuplicates([key, a, b]).select(*df.columns)


_HELD: dict[str, Callable[[], None]] = {}


def holds(owner: str, release: Callable[[], None]) -> None:
    """Say in a task that its process keeps a cache for `owner`; what other operators keep there is released.

    Python workers are reused from stage to stage: without this each would carry the caches of all operators it ever ran.
    """
    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
    _HELD[owner] = release


def text_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, about `most` bytes at a time; nulls are empty.

    A single text longer than `most` makes a slice of its own, so memory follows the longest text, not the batch.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    buffers = col.buffers()
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable.

    Alternating large-star and small-star steps; each is one shuffle by node, so no hub's links meet in the driver
    and the number of steps is logarithmic in the longest chain. Every step's table is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = written(small.where("a > b").distinct(), "links")
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        discard(edges)
        discard(large)
        edges = small
        if not changed:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
