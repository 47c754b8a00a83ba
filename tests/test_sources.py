"""Sources and sinks whose files are cut anywhere: every cut of small texts by hand, then through Spark."""

import random
import gzip
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandfold.functions import bases
from strandfold.operators import kmers
from strandfold.operators.kmers import KmerConfig
from strandfold.sources import blocks, fastq, fastx, packed, ranges


def fastq_text(rng, records):
    def wrapped(s, width):
        return "\n".join(s[i : i + width] for i in range(0, len(s), width))

    out = []
    for _ in range(records):
        n = rng.choice([0, 1, 3, 8, 20])
        seq, quality = wrapped("".join(rng.choices("ACGTN", k=n)), rng.choice([1, 3, 100])), wrapped("".join(rng.choices("@+IJ#", k=n)), rng.choice([2, 4, 100]))
        out += ["@h" + rng.choice(["", "@", "+x"]), *([seq] if seq or rng.random() < 0.5 else []), *[""] * (rng.random() < 0.2), "+" + rng.choice(["", "h"]), *([quality] if quality else []), *[""] * (rng.random() < 0.2)]
    return "\n".join(out)


def lines_by_split(text, cuts):
    """Lines of each split as a line reader deals them: those that begin after its first byte, up to the one at its end."""
    body = text[:-1] if text.endswith("\n") else text
    lines, at, starts = body.split("\n"), 0, []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    edges = [0, *cuts, len(text)]
    return [(s, [x for p, x in zip(starts, lines, strict=True) if (s < p or s == p == 0) and (p <= e)]) for s, e in zip(edges, edges[1:], strict=False)]


def fastq_in_splits(text, cuts):
    splits = [(s, own) for s, own in lines_by_split(text, cuts) if own]
    states, got = {}, []
    for start, kind, size, seq in fastq.composed([fastq.split_function(own) | {"start": s} for s, own in splits]):
        if seq is None:
            states[start] = (kind, size)
        else:
            got.append(seq)
    for s, own in splits:
        got += fastq.fastq_reads(iter(own), *states[s], last=False)
    return sorted(got)


def test_fastq_cut_at_every_byte():
    rng = random.Random(1)
    for _ in range(80):
        text = fastq_text(rng, rng.randint(1, 6)) + rng.choice(["", "\n"])
        if rng.random() < 0.3:
            text = text[: rng.randint(1, len(text))]
        want = sorted(fastq.fastq_reads(iter((text[:-1] if text.endswith("\n") else text).split("\n"))))
        for cut in range(1, len(text)):
            assert fastq_in_splits(text, [cut]) == want, (text, cut)
        for _ in range(10):
            cuts = sorted(rng.sample(range(1, max(2, len(text))), min(len(text) - 1, rng.randint(0, 8))))
            assert fastq_in_splits(text, cuts) == want, (text, cuts)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_fastq_of_mixed_shapes_in_splits(spark, tmp_path, small_splits):
    """Four-line records and then six-line ones: what a reader that counts in fours gets wrong."""
    rng = random.Random(7)
    reads = ["".join(rng.choices("ACGT", k=rng.randint(10, 120))) for _ in range(2500)]
    quality = lambda s: "".join(rng.choices("@+ACGT", k=len(s)))
    half = lambda s: f"{s[: len(s) // 2]}\n{s[len(s) // 2 :]}"
    text = "".join(f"@r\n{s}\n+\n{quality(s)}\n" if i < 1200 else f"@r\n{half(s)}\n+\n{half(quality(s))}\n\n" for i, s in enumerate(reads))
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@x\nACGT\n+\nIIII\n")  # read whole
    got = fastx.read_sequences(spark, str(tmp_path))
    assert Counter(r["seq"] for r in got.collect()) == Counter([*reads, "ACGT"])
    assert fastq.split_lines(spark, [f"{tmp_path}/a.fq"]).select("start").distinct().count() > 10


def windows(seqs, k):
    return Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))


def fasta_records(text):
    out = []
    for i, line in enumerate(text.replace("\r", "").split("\n")):
        if i == 0 or line.startswith(">"):
            out.append("")
        else:
            out[-1] += line
    return out


def fasta_windows(text, k, edges, block):
    file, header, got = pa.BufferReader(text.encode()), True, Counter()
    for s, e in zip(edges, edges[1:], strict=False):
        got += windows([x.decode() for x in ranges.bases_of(file, s, e, header, k, block)], k)
        kind = ranges.last_kind(file, s, e, block)
        header = header if kind is None else kind
    return got


def test_fasta_cut_at_every_byte():
    rng = random.Random(2)
    for _ in range(60):
        lines = [rng.choice([">h", "A", "junk", ""])]
        for _ in range(rng.randint(0, 12)):
            lines.append(">" + rng.choice(["", "x>y"]) if rng.random() < 0.25 else "".join(rng.choices("ACGT", k=rng.choice([0, 1, 3, 9, 40]))))
        text = rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])
        for k in (1, 4, 11):
            want = windows(fasta_records(text), k)
            for block in (1, 3, 100):
                for cut in range(1, len(text)):
                    assert fasta_windows(text, k, [0, cut, len(text)], block) == want, (text, k, block, cut)
                assert fasta_windows(text, k, [*range(0, len(text), 3), len(text)], block) == want or not text


@pytest.mark.parametrize("width", [60, 10**9])
def test_fasta_record_over_many_ranges(spark, tmp_path, width):
    rng = random.Random(3)
    long = "".join(rng.choices("ACGTN", [30] * 4 + [1], k=400_000))
    text = ">one\n" + "\n".join(long[i : i + width] for i in range(0, len(long), width)) + "\n>two\nACGTACGTACGT\n"
    (tmp_path / "a.fa").write_text(text)
    df = ranges.read_pieces(spark, {f"{tmp_path}/a.fa": len(text)}, 21, size=10_000, block=3000)
    lengths = [len(r["seq"]) for r in df.collect()]
    assert len(lengths) > 40 and max(lengths) <= 2 * 3000 + 42
    got = {r["kmer"]: r["cnt"] for r in kmers.count(df, KmerConfig(21, 1)).collect()}
    want = {r["kmer"]: r["cnt"] for r in kmers.count(fastx.read_sequences(spark, f"{tmp_path}/a.fa"), KmerConfig(21, 1)).collect()}
    assert got == want
    for name in ("a.fa", "empty.fa"):
        (tmp_path / name).touch()
    assert {r["kmer"]: r["cnt"] for r in kmers.count(fastx.read_for_counting(spark, str(tmp_path), 21), KmerConfig(21, 1)).collect()} == want


def counts_of(spark, rng, n, k=9):
    rows = list({"".join(rng.choices("ACGT", k=k)): rng.choice([1, 254, 255, 256, 70000]) for _ in range(n)}.items())
    return rows, spark.createDataFrame(rows, "kmer string, cnt bigint")


def test_packed_appends_keep_both(spark, tmp_path):
    rng = random.Random(5)
    a, first = counts_of(spark, rng, 3000)
    b, second = counts_of(spark, rng, 500)
    path = f"{tmp_path}/p"
    packed.write_packed(first.repartition(3), path, 9)
    packed.write_packed(second.repartition(3), path, 9, file_bytes=1000)
    assert sorted(map(tuple, packed.read_packed(spark, path, 9).collect())) == sorted(a + b)
    sizes = [f.stat().st_size for f in (tmp_path / "p").glob("*.bin")]
    assert len(sizes) > 6 and not (tmp_path / "p" / "_temporary").exists()
    packed.write_packed(second, path, 9, mode="overwrite")
    assert sorted(map(tuple, packed.read_packed(spark, path, 9).collect())) == sorted(b)
    # Records as they are, nothing between them, in files of any name and without an index.
    plain = b"".join(bytes(r["record"]) for r in packed.records(second, 9).collect())
    assert sorted(len(f.read_bytes()) for f in (tmp_path / "p").glob("*.bin")) and sum(f.stat().st_size for f in (tmp_path / "p").glob("*.bin")) == len(plain)
    (tmp_path / "other").write_bytes(plain)
    assert sorted(map(tuple, packed.read_packed(spark, f"{tmp_path}/other", 9, block=100).collect())) == sorted(b)
    packed.write_packed(second.limit(0), f"{tmp_path}/none", 9)
    assert packed.read_packed(spark, f"{tmp_path}/none", 9).collect() == []


def test_packed_file_in_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows, df = counts_of(spark, rng, 200_000, 12)
    packed.write_packed(df.coalesce(1), f"{tmp_path}/p", 12)
    (file,) = (tmp_path / "p").glob("*.bin")
    marks = np.frombuffer((tmp_path / "p" / f"{file.name}.index").read_bytes(), "<u8")
    assert len(marks) == -(-len(rows) // packed.BLOCK)
    got = packed.read_packed(spark, f"{tmp_path}/p", 12, part_bytes=100_000, block=1000)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    from pyspark.sql import functions as F

    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_packed_job_that_fails_leaves_the_folder_as_it_was(spark, tmp_path):
    rng = random.Random(8)
    a, first = counts_of(spark, rng, 300)
    path = f"{tmp_path}/p"
    packed.write_packed(first, path, 9)
    other = tmp_path / "p" / "_temporary" / "another-job"
    other.mkdir(parents=True)
    bad = first.selectExpr("if(cnt > 0 and spark_partition_id() > 0, raise_error('lost'), kmer) AS kmer", "cnt").repartition(1).union(first)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            packed.write_packed(bad, path, 9, mode=mode)
        assert sorted(map(tuple, packed.read_packed(spark, path, 9).collect())) == sorted(a)
    assert [p.name for p in (tmp_path / "p" / "_temporary").iterdir()] == ["another-job"]


def test_attempts_that_failed_are_not_taken(tmp_path):
    """Two attempts of one task wrote files; only the one that succeeded is named in the messages."""
    writer = packed._Writer(f"{tmp_path}/p", False, 1 << 20)
    folder = tmp_path / "p" / "_temporary" / writer.job
    folder.mkdir(parents=True)
    for attempt in ("lost", "good"):
        (folder / f"part-00000-0000-{attempt}").write_bytes(bytes.fromhex("4306E0"))
        (folder / f"part-00000-0000-{attempt}.index").write_bytes(bytes(8))
    writer.commit([packed._Written([str(folder / "part-00000-0000-good")]), None])
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == [f"part-00000-0000-{writer.job}.bin", f"part-00000-0000-{writer.job}.bin.index"]


def test_largest_count(spark):
    df = spark.createDataFrame([("ACGT", 2**32 + 5), ("ACGT", 2**32 - 1)], "kmer string, cnt bigint")
    assert {r[0] for r in df.select(bases.record_hex(df["cnt"], df["kmer"], 4)).collect()} == {"FFFFFFFFFF1B"}


def blocked(data, sizes):
    """Gzip of many members that tell their sizes, and the empty one at the end."""
    out, at = b"", 0
    for n in [*sizes, 0]:
        out += blocks.member(data[at : at + n])
        at += n
    assert at >= len(data)
    return out


def test_members_cut_at_every_byte():
    rng = random.Random(4)
    for text in ("", "one\n", "one\ntwo\r\n\nthree", "\n\n", "x" * 50 + "\ny", fastq_text(rng, 5)):
        sizes = []
        while sum(sizes) < len(text):
            sizes.append(rng.randint(1, 12))
        data = blocked(text.encode(), sizes)
        want = [x.rstrip("\r") for x in (text[:-1] if text.endswith("\n") else text).split("\n")] if text else []
        file = pa.BufferReader(data)
        for cut in range(1, len(data)):
            got = [*blocks.lines_of(file, 0, cut), *blocks.lines_of(file, cut, len(data))]
            assert got == want, (text, cut)
        for step in (1, 7, 40):
            assert [x for s in range(0, len(data), step) for x in blocks.lines_of(file, s, min(s + step, len(data)))] == want
        assert gzip.decompress(data).decode() == text
    assert blocks.member_size(zlib.compress(b"x")) is None and blocks.member_size(b"") is None


def test_block_structured_gzip_equals_its_plain_form(spark, tmp_path):
    rng = random.Random(6)
    reads = ["".join(rng.choices("ACGT", k=rng.randint(1, 300))) for _ in range(1500)]
    half = lambda s: f"{s[: len(s) // 2]}\n{s[len(s) // 2 :]}"
    texts = {"a.fa": "".join(f">r\n{half(s)}\n" for s in reads), "b.fq": "".join(f"@r\n{half(s)}\n+\n{'@' * len(s)}\n" for s in reads), "c.ml": "\n".join(reads)}
    for name, text in texts.items():
        sizes = []
        while sum(sizes) < len(text):
            sizes.append(rng.randint(1, 4000))
        at = tmp_path / f"{name}.gz"
        at.write_bytes(blocked(text.encode(), sizes))
        got = fastx.read_sequences(spark, str(at))
        assert Counter(r["seq"] for r in got.collect()) == Counter(reads), name
        small = blocks.read_blocked(spark, {str(at): at.stat().st_size}, fastx.file_kind(str(at))[0], size=20_000)
        assert Counter(r["seq"] for r in small.collect()) == Counter(reads), name
        lines = blocks.read_lines(spark, {str(at): at.stat().st_size}, 20_000)
        assert lines.select("start").distinct().count() > 4
