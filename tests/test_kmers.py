import bz2
import gzip
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.functions import bases
from strandfold.operators import kmers, minimizers
from strandfold.operators.kmers import KmerConfig
from strandfold.plans import job, staged
from strandfold.sources import fastx, packed
from strandfold.streaming import counts as counts_stream


def brute(reads, k, canonical=True):
    out = Counter()
    for seq in reads:
        run = ""
        for c in (seq or "").upper() + "N":
            if c in "ACGT":
                run += c
                continue
            for i in range(len(run) - k + 1):
                x = run[i : i + k]
                rc = x[::-1].translate(str.maketrans("ACGT", "TGCA"))
                out[min(x, rc) if canonical else x] += 1
            run = ""
    return out


def frame(spark, reads):
    return spark.createDataFrame([(r,) for r in reads], "seq string")


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(3)
    made = ["".join(rng.choices("ACGTacgtN.ER", [20] * 4 + [5] * 4 + [1] * 4, k=rng.randint(0, 300))) for _ in range(40)]
    return [*made, *made[:5], "", None, "A" * 600, "ACGTACGT", "acgtacg"]


@pytest.mark.parametrize("k", [8, 15, 16, 31, 32, 33, 63, 64, 65, 135])
@pytest.mark.parametrize("canonical", [True, False])
def test_counts(spark, reads, k, canonical):
    assert rows(kmers.count(frame(spark, reads), KmerConfig(k, 1, canonical))) == brute(reads, k, canonical)


def test_native_equals_packed(spark, reads):
    assert rows(kmers.count_kmers(frame(spark, reads), 21)) == brute(reads, 21)


def test_window_codes_every_width():
    data = np.frombuffer(b"ACGTTGCAACGTNACGGTCATTACGATCCGATTACAGGCATTAGCCAGATCA", np.uint8)
    for k in range(1, 32):
        got = kmers.window_codes(data, np.array([0, len(data)]), k, True)
        want = brute([data.tobytes().decode()], k)
        assert Counter("".join("ACGT"[c >> 2 * (k - 1 - i) & 3] for i in range(k)) for c in got.tolist()) == want


def test_histogram_and_summary(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 511), ("c", 512), ("d", 9999), ("e", 1)], "kmer string, cnt bigint")
    hist = rows(kmers.histogram(counts))
    assert len(hist) == 512 and hist[1] == 2 and hist[511] == 1 and hist[0] == 2 and sum(hist.values()) == 5
    assert tuple(kmers.summary(counts, 3).first()) == (1 + 511 + 512 + 9999 + 1, 5, 2)
    assert tuple(kmers.summary(counts.where("false"), 3).first()) == (0, 0, 0)


@pytest.mark.parametrize("count,kmer,want", [(67, "AACGTG", "4306E0"), (345, "TGGATC", "FF59010000E8D0"), (254, "ACGTA", "FE1B00"), (255, "ACGTA", "FFFF0000001B00")])
def test_codec(spark, count, kmer, want):
    df = spark.createDataFrame([(kmer, count)], "kmer string, cnt bigint")
    assert df.select(bases.record_hex(F.col("cnt"), F.col("kmer"), len(kmer))).first()[0] == want
    assert [(x.tobytes().decode(), int(n)) for letters, counts in packed.decoded(bytes.fromhex(want), len(kmer)) for x, n in zip(letters, counts, strict=True)] == [(kmer, count)]


def test_packed_round_trip(spark, reads, tmp_path):
    counts = kmers.count(frame(spark, reads), KmerConfig(33, 1))
    packed.write_packed(counts, f"{tmp_path}/p", 33)
    assert rows(packed.read_packed(spark, f"{tmp_path}/p/*.bin", 33)) == brute(reads, 33)
    packed.packed_to_fasta(spark, f"{tmp_path}/p/*.bin", 33, f"{tmp_path}/f")
    text = "".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/f").collect())
    assert dict(reversed(x.split("\n")) for x in text.strip(">\n").split("\n>")) == {x: str(n) for x, n in brute(reads, 33).items()}
    with pytest.raises(ValueError):
        list(packed.decoded(bytes.fromhex("4306E0FF01"), 6))


def test_long_counts(spark, tmp_path):
    counts = [("ACGTACGTA", n) for n in (1, 254, 255, 256, 70000, 2)] + [("TTTTTTTTT", 255), ("CCCCCCCCC", 7)]
    packed.write_packed(spark.createDataFrame(counts, "kmer string, cnt bigint").coalesce(1), f"{tmp_path}/p", 9)
    assert [tuple(r) for r in packed.read_packed(spark, f"{tmp_path}/p", 9).collect()] == counts


@pytest.mark.parametrize("k", [28, 64])
def test_long_read(spark, k):
    rng = random.Random(9)
    long = "".join(rng.choices("ACGTN", [30] * 4 + [1], k=300_000))
    df = frame(spark, [long])
    assert rows(kmers.at_least(kmers.count_packed(df, k, most=7000), 1).select(kmers.spelled(k).alias("kmer"), "cnt")) == brute([long], k)
    cut = kmers.cut_reads(df, k, 5000)
    assert cut.count() > 50 and rows(kmers.count(cut, KmerConfig(k, 1))) == brute([long], k)
    assert rows(kmers.count_kmers(frame(spark, [long[:9000]]), k)) == brute([long[:9000]], k)


def test_whole_job(spark, tmp_path, reads):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ml").write_text("\n".join(r or "" for r in reads))
    config = KmerConfig(12, 2, bins=16, m=5)
    want = {x: n for x, n in brute(reads, 12).items() if n >= 2}
    for form in job.FORMATS:
        got = job.run(spark, f"{tmp_path}/in", f"{tmp_path}/{form}", config, form, f"{tmp_path}/{form}-staged", f"{tmp_path}/{form}-hist", f"{tmp_path}/{form}-bins")
        assert rows(got) == want
        assert len(spark.read.text(f"{tmp_path}/{form}-hist").collect()) == 513
        lines = [list(map(int, r[0].split("\t"))) for r in spark.read.text(f"{tmp_path}/{form}-bins").collect()]
        assert [x[0] for x in lines] == list(range(16)) and sum(x[2] for x in lines) == sum(brute(reads, 12).values()) and sum(x[3] for x in lines) == len(brute(reads, 12))
    assert rows(packed.read_packed(spark, f"{tmp_path}/packed", 12)) == want
    with pytest.raises(ValueError):
        job.run(spark, f"{tmp_path}/in", None, config, "other")


def test_split_fastq(spark, tmp_path):
    rng = random.Random(4)
    made = ["".join(rng.choices("ACGTN", k=rng.randint(1, 90))) for _ in range(4000)]
    quality = lambda s: "".join(rng.choices("@+IACGT", k=len(s)))
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{s}\n+\n{quality(s)}\n" for i, s in enumerate(made)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = fastx.read_sequences(spark, f"{tmp_path}/a.fq")
        assert sorted(r["seq"] for r in got.collect()) == sorted(made)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bins_of_few_reads(spark):
    stats = minimizers.bin_stats(minimizers.supermers(frame(spark, ["ACGTACGTAC"]), 8, 5, 64), 64)
    order = {r["ord"]: r["kmers"] for r in minimizers.bin_order(stats, 64).collect()}
    assert len(order) == 64 and sum(order.values()) == 3 and order[64] > 0 and order[1] == 0
    assert minimizers.bin_size_stats(stats).first()["n_bins"] == 64


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ml").write_text("ACGTACGTAC\nTTTTTTTTT\n")
    query = counts_stream.stream_counts(spark, f"{tmp_path}/in", 8).writeStream.format("memory").queryName("kmers").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert rows(spark.table("kmers")) == brute(["ACGTACGTAC", "TTTTTTTTT"], 8)
    finally:
        query.stop()


def test_supermers_and_staging(spark, reads, tmp_path):
    config = KmerConfig(12, 1, bins=16, m=5)
    df = frame(spark, reads)
    made = minimizers.supermers(df, 12, 5, 16).collect()
    assert all(len(r["seq"]) - 11 == r["n_kmers"] for r in made)
    assert sum(r["n_kmers"] for r in made) == sum(brute(reads, 12).values())
    staged.stage_supermers(df, config, f"{tmp_path}/staged")
    assert rows(staged.count_staged(spark, f"{tmp_path}/staged", config)) == brute(reads, 12)
    bins_of = {}
    for r in made:
        for x in brute([r["seq"]], 12):
            assert bins_of.setdefault(x, r["bin"]) == r["bin"]
    with pytest.raises(ValueError):
        staged.count_staged(spark, f"{tmp_path}/staged", KmerConfig(13, 1, bins=16, m=5))


def test_minimizer_table(spark):
    assert minimizers.rank_table(spark, 5, 64).where("allowed").count() == 383
    assert minimizers.rank_table(spark, 7, 512).where("allowed").count() == 5513


@pytest.mark.parametrize("codec", ["", ".gz", ".bz2"])
def test_sources(spark, tmp_path, codec):
    opened = {"": open, ".gz": gzip.open, ".bz2": bz2.open}[codec]
    texts = {
        "a.fa": (">a x>y\nACGTNAC\nGT\n\n>b\nTTTT\nGG", ["ACGTNACGT", "TTTTGG"]),
        "b.fq": ("@r1\nACGT\nAC\n+\n+@II\nII\n@r2\nTTT\n+r2\n@II\n", ["ACGTAC", "TTT"]),
        "c.ml": ("ACGT\n\nTT\r\n", ["ACGT", "", "TT"]),
        "d.fa": (">a x>y\r\nACGTNAC\r\nGT\r\n\r\n>b\r\nTTTT\r\nGG", ["ACGTNACGT", "TTTTGG"]),
    }
    for name, (text, want) in texts.items():
        with opened(tmp_path / (name + codec), "wb") as f:
            f.write(text.encode())
        got = [r["seq"] for r in fastx.read_sequences(spark, str(tmp_path / (name + codec))).collect()]
        assert sorted(got) == sorted(want)


def test_paths(spark, tmp_path):
    for name in ("x.fa", "y.fa"):
        (tmp_path / name).write_text(">a\nACGT\n")
    (tmp_path / "sub").mkdir()
    assert len(fastx.expand(spark, str(tmp_path))) == 2
    (tmp_path / "sub" / "list.txt").write_text(f"{tmp_path}/x.fa\n{tmp_path}/y.fa\n")
    assert len(fastx.expand(spark, str(tmp_path / "sub" / "list.txt"))) == 2
    (tmp_path / "z.fq").write_text("@a\nA\n+\nI\n")
    for bad in (tmp_path, tmp_path / "none.fa", tmp_path / "sub"):
        with pytest.raises(ValueError):
            fastx.expand(spark, str(bad))


def test_config():
    assert [kmers.auto_minimizer(n) for n in (2, 64, 512, 4096)] == [5, 6, 7, 9]
    for bad in ({"k": 7}, {"k": 136}, {"min_count": 0}, {"bins": 1}, {"m": 4}):
        with pytest.raises(ValueError):
            KmerConfig(**bad)
