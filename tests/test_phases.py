"""Bins, their refinement, the two phases of the job, and counts that grow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandfold.functions import bases
from strandfold.operators import kmers, minimizers
from strandfold.operators.kmers import KmerConfig
from strandfold.plans import job, staged
from strandfold.sources import packed


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)


def brute(seqs, k, canonical=True):
    flip = str.maketrans("ACGT", "TGCA")
    out = Counter()
    for s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k].upper()
            if not w.strip("ACGT"):
                out[min(w, w[::-1].translate(flip)) if canonical else w] += 1
    return out


def rows(df):
    return {r["kmer"]: r["cnt"] for r in df.collect()}


@pytest.fixture(scope="module")
def skewed():
    """Poly-A, one repeat of a short unit, and random reads."""
    rng = random.Random(2)
    plain = ["".join(rng.choices("ACGTN", [20] * 4 + [1], k=rng.randint(5, 400))) for _ in range(150)]
    return [*plain, *["A" * 700] * 40, *["ACGTTGCA" * 60] * 20, "TTTTT" * 100, None, ""]


@pytest.mark.parametrize("k", [12, 33])
def test_oversize_bins_are_refined(spark, skewed, tmp_path, k):
    config, limit = KmerConfig(k, 1, bins=16, m=5), 3000
    reads = frame(spark, skewed)
    parts, sizes = staged.refine(reads, config, limit)
    assert max(sizes.values()) <= limit and any(p >> 50 for p in sizes)
    path = f"{tmp_path}/staged"
    staged.stage_supermers(reads, config, path, limit)
    stored = staged.read_staged(spark, path, config)
    # What a task reads, in k-mers that its rows hold, and that sub-bins are the bin.
    by_slot = stored.groupBy("slot").agg(F.sum("n_kmers").alias("n")).collect()
    assert max(r["n"] for r in by_slot) <= 2 * limit
    own = {r["bin"]: r["n"] for r in stored.groupBy("bin").agg(F.sum(F.col("n_kmers") * F.col("copies")).alias("n")).collect()}
    plain = minimizers.supermers(reads, k, 5, 16).groupBy("bin").agg(F.sum("n_kmers").alias("n"))
    assert own == {r["bin"]: r["n"] for r in plain.collect()}
    want = brute(skewed, k)
    assert rows(staged.count_staged(spark, path, config)) == want
    assert rows(staged.count_staged(spark, path, KmerConfig(k, 5, bins=16, m=5))) == {x: n for x, n in want.items() if n >= 5}
    assert rows(staged.count_staged(spark, path, KmerConfig(k, 1, canonical=False, bins=16, m=5))) == brute(skewed, k, False)


def test_staged_bins_are_counted_without_a_shuffle(spark, skewed, tmp_path):
    config = KmerConfig(12, 2, bins=64, m=5)
    staged.stage_supermers(frame(spark, skewed), config, f"{tmp_path}/s", 5000)
    counted = staged.count_staged(spark, f"{tmp_path}/s", config)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan" in plan
    assert rows(counted) == {x: n for x, n in brute(skewed, 12).items() if n >= 2}
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("staged")] == []


def test_slots_are_even():
    rng = random.Random(1)
    for _ in range(50):
        sizes = {i: rng.randint(1, 100) for i in range(rng.randint(1, 60))}
        slots, n = staged._slots(sizes, 100)
        load = Counter()
        for part, slot in slots.items():
            load[slot] += sizes[part]
        assert slots.keys() == sizes.keys() and len(load) == n and max(load.values()) <= 200


def test_bins_of_nothing(spark, tmp_path):
    config = KmerConfig(12, 1, bins=16, m=5)
    staged.stage_supermers(frame(spark, ["ACGT", None]), config, f"{tmp_path}/s")
    assert staged.count_staged(spark, f"{tmp_path}/s", config).collect() == []


def test_second_phase_alone(spark, skewed, tmp_path):
    """Staged once, then counted with other thresholds, formats and side outputs by the manifest alone."""
    path = f"{tmp_path}/s"
    job.stage(spark, frame(spark, skewed), path, KmerConfig(15, 7, bins=16, m=5))
    told = staged.manifest(spark, path)
    assert (told["k"], told["m"], told["bins"], told["kmers"]) == (15, 5, 16, sum(brute(skewed, 15).values()))
    want = brute(skewed, 15)
    for least, form in ((1, "none"), (4, "packed"), (2, "fasta")):
        out = f"{tmp_path}/{form}"
        done = job.count_bins(spark, path, out, least, format=form, histogram=f"{out}-h", bin_stats=f"{out}-b")
        assert rows(done.kept) == {x: n for x, n in want.items() if n >= least}
        assert (done.totals.reads, done.totals.kmers, done.totals.ukmers, done.totals.below_threshold) == (None, sum(want.values()), len(want), sum(n < least for n in want.values()))
        assert len(spark.read.text(f"{out}-h").collect()) == 513 and len(spark.read.text(f"{out}-b").collect()) == 16
        done.release()
    assert not (tmp_path / "none").exists()
    assert rows(packed.read_packed(spark, f"{tmp_path}/packed", 15)) == {x: n for x, n in want.items() if n >= 4}
    assert rows(job.count_bins(spark, path, None, 1, canonical=False, format="none").kept) == brute(skewed, 15, False)


def test_totals_come_from_one_pass(spark, skewed, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ml").write_text("".join(f"{s or chr(32)}\n" for s in skewed))
    spent = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            spent.add(b.num_rows)
            yield b

    reads = spark.read.text(f"{tmp_path}/in").select(F.col("value").alias("seq")).mapInArrow(passed, "seq string")
    done = job.execute(spark, reads, f"{tmp_path}/out", KmerConfig(12, 2), histogram=f"{tmp_path}/h")
    want = brute(skewed, 12)
    seen = done.totals
    assert spent.value == len(skewed) == seen.reads
    assert seen.bases == sum(c in "ACGT" for s in skewed for c in s or "")
    assert (seen.kmers, seen.ukmers, seen.below_threshold) == (sum(want.values()), len(want), sum(n < 2 for n in want.values()))
    assert rows(packed.read_packed(spark, f"{tmp_path}/out", 12)) == rows(done.kept) == {x: n for x, n in want.items() if n >= 2}


def test_counts_that_grow(spark, skewed, tmp_path):
    config, table = KmerConfig(12, 2, bins=16, m=5), f"{tmp_path}/counts"
    for part in (skewed[:60], skewed[60:61], skewed[61:]):
        job.add_reads(spark, frame(spark, part), table, config)
    assert rows(job.read_counts(spark, table, config)) == {x: n for x, n in brute(skewed, 12).items() if n >= 2}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "counts").glob("bin=*/*.parquet")}
    job.add_reads(spark, frame(spark, ["ACGTTGCAACGA"]), table, config)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "counts").glob("bin=*/*.parquet")}
    assert 0 < len(after.keys() - before.keys()) <= 2 and sum(before[p] == after.get(p) for p in before) >= len(before) - 2
    again = bases.reverse_complement(F.lit("ACGTTGCAACGA"))
    assert spark.range(1).select(again.alias("x")).first()["x"] == "TCGTTGCAACGT"
    assert rows(job.read_counts(spark, table, KmerConfig(12, 1, bins=16, m=5))) == brute([*skewed, "ACGTTGCAACGA"], 12)


def test_reads_of_all_kinds_through_the_job(spark, skewed, tmp_path):
    config = KmerConfig(12, 2)
    plain = [s for s in skewed if s]
    texts = {"a.fa": "".join(f">r\n{s}\n" for s in plain), "b.fq": "".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in plain), "c.ml": "\n".join(plain)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        done = job.execute(spark, f"{tmp_path}/{name}", None, config, "none")
        assert rows(done.kept) == {x: n for x, n in brute(plain, 12).items() if n >= 2}, name
        assert done.totals.kmers == sum(brute(plain, 12).values())
