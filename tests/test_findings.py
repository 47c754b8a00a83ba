"""Findings of reviews of the counting engine: each test failed before its change."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandfold.operators import bundles, kmers, minimizers
from strandfold.operators.kmers import KmerConfig
from strandfold.plans import catalogue, job, staged
from strandfold.sources import packed


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def documents(spark, path, texts):
    """A folder with these documents."""
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(40)]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)]
    return [*made, *made[:30], None, "", "+49 30 1234567 " + made[0], "@" + made[1], "++" + made[2], "+", "a\n+b " + made[3]]


@pytest.mark.parametrize("query", ["fastq_gzip_roundtrip", "fastq_roundtrip"])
def test_texts_that_begin_like_a_separator(spark, tmp_path, texts, query):
    d = documents(spark, tmp_path, texts)
    assert rows(getattr(catalogue, query)(spark, d)) == rows(kmers.count(catalogue.documents(spark, d), catalogue.FLAGSHIP))


def bundle_rows(seqs, k, canonical=True, bits=7):
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    return list(bundles._rows(data, np.cumsum([0, *map(len, seqs)]), k, canonical, lambda x: bundles.hash_parts(x, k, canonical, bits)))


@pytest.mark.parametrize("k", [32, 64, 135])
def test_what_moves_is_super_mers(k):
    """Bytes that are moved for a k-mer: 16 to 48 before, of its words and count."""
    rng = random.Random(k)
    reads = ["".join(rng.choices("ACGT", k=1500)) for _ in range(40)]
    moved = sum(b.column("lengths").nbytes + b.column("bases").nbytes for b in bundle_rows(reads, k))
    assert moved < 2.5 * 40 * (1500 - k + 1)


@pytest.mark.parametrize("k", [28, 33, 135])
@pytest.mark.parametrize("held", [1 << 22, 300])
def test_bundles_are_counted_in_bounded_memory(k, held):
    """Counts of every part, heavy ones too, equal those of the windows; what is not held lies in files."""
    rng = random.Random(3)
    reads = ["".join(rng.choices("ACGTn", [20] * 4 + [1], k=rng.randint(0, 700))) for _ in range(60)] + ["A" * 40_000, "ACG" * 9000, "t" * 30]
    data, offsets = np.frombuffer("".join(reads).encode(), np.uint8), np.cumsum([0, *map(len, reads)])
    want = Counter(zip(*(w.tolist() for w in kmers.window_words(data, offsets, k, True)), strict=True))
    tallies, got = {}, Counter()
    for b in bundle_rows(reads, k):
        copies = b.column("copies")
        for i, part in enumerate(b.column("part").to_pylist()):
            t = tallies.setdefault(part, bundles.Tally(len(kmers.words_of(k)), held))
            bundles.added(t, bundles.raw(b.column("lengths"), i, i + 1, "<u2"), bundles.raw(b.column("bases"), i, i + 1, "u1"), k, True, bundles.raw(copies, i, i + 1, "<i8") if copies[i].is_valid else None, most=200)
            assert t.size * t.width < held
    for t in tallies.values():
        for words, n in t.done():
            for *row, c in zip(*(w.tolist() for w in words), n.tolist(), strict=True):
                assert tuple(row) not in got
                got[tuple(row)] = c
    assert got == want


def test_hashes_that_collide(monkeypatch):
    monkeypatch.setattr(bundles, "hashed", lambda words: np.zeros(len(words[0]), np.uint64))
    words, n = bundles.summed([np.array([1, 2, 1, 2]), np.array([5, 5, 5, 6])], None)
    assert sorted(zip(*(w.tolist() for w in words), n.tolist(), strict=True)) == [(1, 5, 2), (2, 5, 1), (2, 6, 1)]


def brute(seqs, k):
    flip = str.maketrans("ACGT", "TGCA")
    return Counter(min(w, w[::-1].translate(flip)) for s in seqs for i in range(len(s or "") - k + 1) if not (w := s[i : i + k]).strip("ACGT"))


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(17)
    return ["".join(rng.choices("ACGTN", [20] * 4 + [1], k=rng.randint(0, 500))) for _ in range(80)] + ["A" * 900, None, ""]


def test_kmers_of_documents(spark, reads):
    """Documents of several rows, and of no id."""
    ids = [None if i % 9 == 0 else i % 30 for i in range(len(reads))]
    df = spark.createDataFrame(list(zip(ids, reads, strict=True)), "doc_id bigint, seq string").repartition(5)
    want = {i: Counter() for i in ids}
    for i, s in zip(ids, reads, strict=True):
        want[i] += brute([s], 28)
    got = {r[0]: (r[1], r[2]) for r in bundles.distinct_by(df, "doc_id", 28, most=1000).collect()}
    assert got == {i: (sum(c.values()), len(c)) for i, c in want.items() if c}


def test_distinct_kmers_of_bins(spark, reads):
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3)
    want = brute(reads, 28)
    got = minimizers.distinct_per_bin(df, 28, 5, 16).collect()
    assert (sum(r["kmers"] for r in got), sum(r["ukmers"] for r in got)) == (sum(want.values()), len(want))
    stats = minimizers.bin_stats(minimizers.supermers(df, 28, 5, 16), 16).where("kmers > 0").collect()
    assert {r["bin"]: r["kmers"] for r in got} == {r["bin"]: r["kmers"] for r in stats}


def test_staged_bundles_and_slots(spark, reads, tmp_path, monkeypatch):
    """Few bytes a k-mer; small parts do not make as many slots; statistics leave the tasks as numbers."""
    df, config = spark.createDataFrame([(s,) for s in reads], "seq string"), KmerConfig(28, 1, bins=16, m=5)
    monkeypatch.setattr(staged, "SLOTS", 3)
    want = brute(reads, 28)
    for name, limit in (("whole", 1 << 26), ("refined", 100)):
        path = f"{tmp_path}/{name}"
        staged.stage_supermers(df, config, path, limit)
        assert staged.manifest(spark, path)["slots"] <= 3
        assert rows(staged.count_staged(spark, path, config)) == want
        stored = staged.read_staged(spark, path, config)
        stats = staged.part_stats(stored, 28, True).agg(F.sum("kmers"), F.sum("ukmers")).first()
        assert tuple(stats) == (sum(want.values()), len(want))
        if name == "whole":
            assert stored.agg(F.sum(F.length("lengths") + F.length("bases"))).first()[0] < 2.5 * sum(want.values())


def test_a_new_table_of_counts_has_no_copy(spark, reads, tmp_path, monkeypatch):
    made, config = [], KmerConfig(28, 1, bins=16, m=5)
    monkeypatch.setattr(job, "scratch", lambda s, name: made.append(name) or f"{tmp_path}/{name}-{len(made)}")
    df = spark.createDataFrame([(s,) for s in reads], "seq string")
    job.add_reads(spark, df, f"{tmp_path}/table", config)
    assert made == ["staged"]
    job.add_reads(spark, df, f"{tmp_path}/table", config)
    assert rows(job.read_counts(spark, f"{tmp_path}/table", config)) == {x: 2 * n for x, n in brute(reads, 28).items()}
    assert made == ["staged", "staged", "merged"] and sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_small_packed_files_do_not_make_as_many_tasks(spark, tmp_path):
    counts = spark.range(30_000).select(F.lpad(F.translate(F.conv(F.col("id").cast("string"), 10, 4), "0123", "ACGT"), 12, "A").alias("kmer"), F.lit(3).cast("bigint").alias("cnt"))
    packed.write_packed(counts.repartition(8), f"{tmp_path}/p", 12, file_bytes=1 << 10)
    found = packed.read_packed(spark, f"{tmp_path}/p", 12, part_bytes=1 << 9)
    assert len(list((tmp_path / "p").glob("*.bin"))) > 100
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert found.count() == found.distinct().count() == 30_000
