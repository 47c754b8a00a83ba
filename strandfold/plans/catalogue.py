"""Registered queries of the counting engine and their SQL. Reads come from ordinary tables through adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.functions import bases
from strandfold.operators import bundles, kmers, minimizers
from strandfold.operators.kmers import KmerConfig
from strandfold.plans import job, staged
from strandfold.plans.job import scratch
from strandfold.sources import blocks, fastx, packed, ranges

FLAGSHIP = KmerConfig()
M, BINS = 5, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bases.from_text(F.col("text")).alias("seq"))


# SQL fragments.
ADAPT = f"translate({{}}, '{bases.TEXT_FROM}', '{bases.TEXT_TO}')"
READS = f"reads AS (SELECT doc_id AS id, {ADAPT.format('text')} AS seq FROM documents)"
RUNS = "runs AS (SELECT id, upper(unnest(regexp_extract_all(seq, '[ACGTacgt]+'))) AS run FROM reads)"


def windows_sql(k: int, canonical: bool = True, reads: str = READS) -> str:
    kmer = f"substr(run, i::INT, {k})"
    if canonical:
        kmer = f"least({kmer}, substr(rc, (length(run) - {k} + 2 - i)::INT, {k}))"
    return f"""WITH {reads}, {RUNS},
w AS (SELECT id, run, translate(reverse(run), 'ACGT', 'TGCA') AS rc, unnest(range(1, length(run) - {k} + 2)) AS i FROM runs WHERE length(run) >= {k}),
kmers AS (SELECT id, i, run, {kmer} AS kmer FROM w)"""


def counts_sql(k: int, least: int = 1, canonical: bool = True, reads: str = READS) -> str:
    return windows_sql(k, canonical, reads) + f", counts AS (SELECT kmer, count(*) AS cnt FROM kmers GROUP BY kmer HAVING count(*) >= {least})"


def _kmer_queries() -> tuple[dict, dict]:
    q: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    sweep = {f"kmer_count_k{k}_l{least}": KmerConfig(k, least) for k, least in ((28, 3), (8, 3), (15, 3), (16, 3), (31, 3), (32, 1), (33, 3), (64, 2), (135, 1))}
    sweep |= {"kmer_count_noncanonical": KmerConfig(28, 3, canonical=False), "kmer_count_l1": KmerConfig(21, 1), "kmer_count_l10": KmerConfig(28, 10)}
    for name, c in sweep.items():
        q[name] = lambda s, d, c=c: kmers.count(documents(s, d), c)
        sql[name] = counts_sql(c.k, c.min_count, c.canonical) + " SELECT kmer, cnt FROM counts"
    q["native_kmer_count_k28"] = lambda s, d: kmers.at_least(kmers.count_kmers(documents(s, d), 28), 3)
    sql["native_kmer_count_k28"] = sql["kmer_count_k28_l3"]
    q["arrow_kmer_count_k28"] = lambda s, d: kmers.at_least(kmers.count_packed(documents(s, d), 28), 3)
    code = "list_sum([(position(substr(kmer, j::INT, 1) IN 'ACGT') - 1) * (1::BIGINT << (2 * ({k} - j))::INT) FOR j IN range(1, {k} + 1)])::BIGINT"
    sql["arrow_kmer_count_k28"] = counts_sql(28, 3) + f" SELECT {code.format(k=28)} AS code, cnt FROM counts"
    return q, sql


def base_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = documents(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("c"))
    return one.where("c != ''").groupBy(F.when(F.upper("c").isin(*bases.BASES), F.upper("c")).otherwise("other").alias("base")).agg(F.count("*").alias("n"))


def acgt_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.split_runs(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.max(F.length("run")).cast("bigint").alias("longest"))


def short_run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.split_runs(documents(spark, sf_dir), 28).groupBy(F.length("run").cast("bigint").alias("run_length")).agg(F.count("*").alias("n"))


def kmers_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.distinct_by(documents(spark, sf_dir), "doc_id", 28)


def revcomp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.split_runs(documents(spark, sf_dir), 28).select("doc_id", bases.reverse_complement(F.col("run")).alias("rc")).distinct()


def palindromes_even_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmers.count(documents(spark, sf_dir), KmerConfig(8, 1), unfiltered=True)
    return counts.where(F.col("kmer") == bases.reverse_complement(F.col("kmer")))


def histogram_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.histogram(kmers.count_packed(documents(spark, sf_dir), 12))


def histogram_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.histogram_lines(histogram_512(spark, sf_dir))


def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.summary(kmers.count_packed(documents(spark, sf_dir), 28), 3)


def base_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.base_totals(documents(spark, sf_dir), 28)


def kmer_packed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(documents(spark, sf_dir), KmerConfig(12, 3)).select("kmer", bases.packed_code(F.col("kmer")).alias("code"), "cnt")


def packed_record_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmers.count(documents(spark, sf_dir), KmerConfig(10, 3))
    return counts.select("kmer", bases.record_hex(F.col("cnt"), F.col("kmer"), 10).alias("record"))


def packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmers.count(documents(spark, sf_dir), KmerConfig(33, 3))
    return counts.select(bases.from_packed_hex(bases.packed_hex(F.col("kmer"), 33), 33).alias("kmer"), "cnt")


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.fasta_lines(kmers.count(documents(spark, sf_dir), FLAGSHIP))


def _ranks_in_use(spark: SparkSession, sf_dir: str, m: int, bins: int) -> DataFrame:
    """Every m-mer with its rank and bin, and how often the documents hold it, on either strand."""
    found = kmers.count_kmers(documents(spark, sf_dir), m)
    ranks = minimizers.rank_table(spark, m, bins)
    return ranks.join(found.withColumnRenamed("kmer", "mmer"), "mmer", "left").select("mmer", "allowed", "rnk", "bin", F.coalesce("cnt", F.lit(0)).alias("n"))


def minimizer_rank_m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks_in_use(spark, sf_dir, 5, BINS)


def minimizer_rank_m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks_in_use(spark, sf_dir, 7, 512)


def _supermers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.supermers(documents(spark, sf_dir).select("seq"), 28, M, BINS)


def kmers_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.bin_stats(_supermers(spark, sf_dir), BINS)


def distinct_kmers_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.distinct_per_bin(documents(spark, sf_dir), 28, M, BINS)


def bin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.bin_order(kmers_per_bin(spark, sf_dir), BINS)


def bin_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.bin_size_stats(kmers_per_bin(spark, sf_dir))


def empty_bins_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bins in order, of reads so few that most bins are empty."""
    few = table(spark, sf_dir, "region").select(bases.from_text(F.col("r_name")).alias("seq"))
    return minimizers.bin_order(minimizers.bin_stats(minimizers.supermers(few, 8, M, BINS), BINS), BINS)


def supermers_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supermers(spark, sf_dir).groupBy("bin").agg(F.sum("n_kmers").alias("kmers"), F.sum(F.length("seq") - 27).alias("by_length"))


STAGED = KmerConfig(28, 3, bins=BINS, m=M)


def staged_equals_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-mers written by bin in the shared folder, counted from there."""
    path = scratch(spark, "staged")
    staged.stage_supermers(documents(spark, sf_dir).select("seq"), STAGED, path)
    return staged.count_staged(spark, path, STAGED)


NAMES = ["a.fastq", "b.fq.gz", "c.fasta", "d.fa.bz2", "e.ml", "f.ml.gz", "g.FASTA", "h.txt.gz", "i", "j.fa.zip", "k.gz"]


def file_type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and codecs of a file name for every document."""
    endings = F.array(*map(F.lit, NAMES))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), "source", F.lit("."), F.element_at(endings, (F.col("doc_id") % len(NAMES) + 1).cast("int"))).alias("name"))
    kind, codec = fastx.kind_columns(F.col("name"))
    return rows.select("doc_id", "name", kind.alias("type"), codec.alias("codec"))


def auto_minimizer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimizer length for as many bins as a document has characters, within the range of bins."""
    bins = (F.col("n_chars") % 4095 + 2).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", bins.alias("bins"), kmers.minimizer_length(bins).cast("bigint").alias("m"))


def multi_source_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = documents(spark, sf_dir).select("seq")
    for name in ("benchmark", "conversations"):
        reads = reads.union(table(spark, sf_dir, name).select(bases.from_text(F.col("text"))))
    return kmers.count(reads, FLAGSHIP)


def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.create_map(*(F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "error"), "ACGTN", strict=True) for x in pair))
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", letter[F.col("event_type")].alias("b")).alias("e"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["b"]), "").alias("seq"))


def event_sequence_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(event_reads(spark, sf_dir).select("seq"), KmerConfig(8, 1))


def lineitem_sequence_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat("l_returnflag", "l_linestatus")
    base = F.when(pair == "AF", "A").when(pair == "AO", "C").when(pair == "RF", "G").when(pair == "RO", "T").otherwise("N")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber", base.alias("b")).alias("e"))
    reads = rows.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["b"]), "").alias("seq"))
    return kmers.count(reads.select("seq"), KmerConfig(8, 1))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace("seq", r"[\r\n]", "N").alias("seq"))


def _written_lines(spark: SparkSession, line, sf_dir: str, codec: str) -> str:
    path = scratch(spark, "reads")
    _lines(spark, sf_dir).select(line).write.option("compression", codec).text(path)
    return path


def fastx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as plain FASTA in the shared folder and read back through the source."""
    line = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), "seq")
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, line, sf_dir, "none"), "fasta"), FLAGSHIP)


def fasta_bzip2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA with its bases in lines of at most 60, CRLF, bzip2."""
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\r\n")
    line = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\r\n"), wrapped)
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, line, sf_dir, "bzip2"), "fasta"), FLAGSHIP)


def _fastq_line():
    # A line of bases must not begin with `+`; N is no base either.
    seq = F.regexp_replace("seq", r"^\+", "N")
    return F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), F.regexp_replace(seq, "(?s).", "@"))


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, _fastq_line(), sf_dir, "none"), "fastq"), FLAGSHIP)


def fastq_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, _fastq_line(), sf_dir, "gzip"), "fastq"), FLAGSHIP)


def lines_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, F.col("seq"), sf_dir, "gzip"), "lines"), FLAGSHIP)


def packed_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with packed output, staging and both side outputs; its binary files read back."""
    out, staging = scratch(spark, "packed"), scratch(spark, "staged")
    job.run(spark, documents(spark, sf_dir), out, STAGED, "packed", staging)
    return packed.read_packed(spark, out, 28)


def packed_to_fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files turned into FASTA text, whose lines are read back."""
    out, fasta = scratch(spark, "packed"), scratch(spark, "fasta")
    job.run(spark, documents(spark, sf_dir), out, FLAGSHIP, "packed")
    packed.packed_to_fasta(spark, out, 28, fasta)
    lines = spark.read.option("lineSep", "\n>").text(fasta)
    return lines.select(F.concat(F.lit(">"), F.regexp_replace("value", "^>|\n$", "")).alias("line"))


def _wrapped(column, width: int):
    return F.regexp_replace(column, f"(.{{{width}}})(?=.)", "$1\n")


def fastq_multiline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ with bases in lines of 70, qualities that begin with `@` and `+` in lines of 90 and a blank line between records;
    files beyond the least split are parsed in splits that begin anywhere."""
    # Lines of bases must not begin with `+`.
    plain = F.regexp_replace("seq", "[^ACGT]", "N")
    quality = _wrapped(F.regexp_replace(F.regexp_replace(plain, "^.", "@"), "(?<=.)[AC]", "+"), 90)
    line = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("\n"), _wrapped(plain, 70), F.lit("\n+\n"), quality, F.lit("\n"))
    return kmers.count(fastx.read_sequences(spark, _written_lines(spark, line, sf_dir, "none"), "fastq"), FLAGSHIP)


def fasta_ranges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA of wrapped bases read by byte ranges far shorter than the files."""
    line = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), _wrapped(F.col("seq"), 60))
    path = _written_lines(spark, line, sf_dir, "none")
    sizes = {p: fastx._size(spark, p) for p in fastx.expand(spark, path, "fasta")}
    return kmers.count(ranges.read_pieces(spark, sizes, 28, size=1 << 18, block=1 << 16), FLAGSHIP)


def _renamed(spark: SparkSession, names: list[str], ending: str) -> list[str]:
    fs = spark._jvm.org.apache.hadoop.fs
    for name in names:
        at = fs.Path(name)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, fs.Path(name + ending))
    return [name + ending for name in names]


def path_list_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by a text file, one path a line."""
    names = fastx.expand(spark, _written_lines(spark, F.col("seq"), sf_dir, "none"), "lines")
    # A path list is told by its extension, and paths in it by theirs.
    moved = _renamed(spark, names, ".ml")
    listed = scratch(spark, "paths")
    spark.createDataFrame([(m,) for m in moved], "path string").coalesce(1).write.text(listed)
    (listing,) = (r["path"] for r in spark.read.format("binaryFile").load(listed).select("path").collect())
    return kmers.count(fastx.read_sequences(spark, listing), FLAGSHIP)


def gzip_blocks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-per-read files as gzip of many members, read back by byte ranges of the compressed files."""
    path = scratch(spark, "blocks")
    spark.dataSource.register(packed.PackedSink)
    blocks.members_of_lines(_lines(spark, sf_dir).select("seq")).write.format("packed").mode("append").save(path)
    files = [p for p in fastx.expand(spark, path, "lines") if p.endswith(".bin")]
    sizes = {p: fastx._size(spark, p) for p in _renamed(spark, files, ".ml.gz")}
    return kmers.count(blocks.read_blocked(spark, sizes, "lines", size=1 << 18).select("seq"), FLAGSHIP)


def packed_append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written to one folder by two jobs, the k-mers of either strand's first half apart; both are read back."""
    found, out = scratch(spark, "counts"), scratch(spark, "packed")
    kmers.count(documents(spark, sf_dir), FLAGSHIP).write.parquet(found)
    counts = spark.read.parquet(found)
    for half in (F.col("kmer") < "AG", F.col("kmer") >= "AG"):
        packed.write_packed(counts.where(half), out, 28, file_bytes=1 << 16)
    return packed.read_packed(spark, out, 28, part_bytes=1 << 14)


def count_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job without an output file."""
    return job.execute(spark, documents(spark, sf_dir), None, FLAGSHIP, "none").kept


def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All totals of the job as observed in its one pass over the reads."""
    done = job.execute(spark, documents(spark, sf_dir), None, FLAGSHIP, "none")
    t = done.totals
    done.release()
    return spark.createDataFrame([(t.reads, t.bases, t.kmers, t.ukmers, t.below_threshold)], "reads bigint, bases bigint, kmers bigint, ukmers bigint, below_threshold bigint")


def second_phase_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins staged by one call, counted by another that knows only where they are, with another threshold."""
    staging = scratch(spark, "staged")
    job.stage(spark, documents(spark, sf_dir), staging, STAGED)
    return job.count_bins(spark, staging, None, 10, format="none").kept


def refined_bins_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins held to 20,000 k-mers, so that many are refined."""
    path = scratch(spark, "staged")
    staged.stage_supermers(documents(spark, sf_dir).select("seq"), STAGED, path, 20_000)
    return staged.count_staged(spark, path, STAGED)


def counts_that_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of reads added to a table of counts, one after the other."""
    at = scratch(spark, "growing")
    for reads in (documents(spark, sf_dir), table(spark, sf_dir, "conversations").select(bases.from_text(F.col("text")).alias("seq"))):
        job.add_reads(spark, reads, at, STAGED)
    return job.read_counts(spark, at, STAGED)


def histogram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram's text file read back, its lines numbered by what they say."""
    path = scratch(spark, "histogram")
    kmers.write_histogram(histogram_512(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.select(F.coalesce(F.regexp_extract("line", "^..([ 0-9]{3});", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("ord"), "line")


def bin_stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins' statistics file read back; the number of super-mers, which is this engine's own, left out."""
    staging, path = scratch(spark, "staged"), scratch(spark, "bins")
    staged.stage_supermers(documents(spark, sf_dir).select("seq"), STAGED, staging)
    job.write_bin_stats(spark, staging, STAGED, path)
    part = F.split("value", "\t")
    return spark.read.text(path).select(*(part[i].cast("bigint").alias(c) for i, c in ((0, "bin"), (2, "kmers"), (3, "ukmers"))))


def _ranks_sql(m: int, bins: int) -> str:
    b = 2 * bins
    whole = 4**m - 4**m % b
    p = max(1, whole // b)
    return f"""codes AS (SELECT unnest(range(0, {4**m})) AS code),
mmers AS (SELECT code, list_aggregate([substr('ACGT', ((code >> (2 * ({m} - j))::INT) & 3)::INT + 1, 1) FOR j IN range(1, {m} + 1)], 'string_agg', '') AS mmer FROM codes),
fine AS (SELECT code, mmer, mmer <= translate(reverse(mmer), 'ACGT', 'TGCA') AND mmer NOT IN ('AA{"G" * (m - 2)}', 'AA{"C" * (m - 2)}') AND position('AA' IN substr(mmer, 2)) = 0 AND mmer NOT LIKE 'ACA%' AS allowed FROM mmers),
rk AS (SELECT mmer, allowed, row_number() OVER (ORDER BY NOT allowed, code) - 1 AS rnk FROM fine),
qs AS (SELECT *, (rnk + ((rnk // {b}) * {b}) // {p}) % {b} - {bins} AS x FROM rk),
ranks AS (SELECT mmer, allowed, rnk, (CASE WHEN rnk < {whole} THEN CASE WHEN x < 0 THEN -x - 1 ELSE x END ELSE {bins} - 1 - rnk % {bins} END)::BIGINT AS bin FROM qs)"""


def _bins_sql(k: int = 28, m: int = M, bins: int = BINS, reads: str = READS) -> str:
    return f"""WITH {reads}, {RUNS}, {_ranks_sql(m, bins)},
numbered AS (SELECT row_number() OVER () AS rid, run FROM runs WHERE length(run) >= {k}),
mpos AS (SELECT rid, run, unnest(range(1, length(run) - {m} + 2)) AS i FROM numbered),
mm AS (SELECT rid, run, i, least(substr(run, i::INT, {m}), translate(reverse(substr(run, i::INT, {m})), 'ACGT', 'TGCA')) AS mmer FROM mpos),
joined AS (SELECT rid, run, i, rnk FROM mm JOIN ranks USING (mmer)),
rolled AS (SELECT rid, run, i, min(rnk) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - m} FOLLOWING) AS rnk FROM joined),
kb AS (SELECT rid, run, i, ranks.bin FROM rolled JOIN ranks USING (rnk) WHERE i <= length(run) - {k} + 1),
found AS (SELECT bin, count(*) AS kmers FROM kb GROUP BY bin),
stats AS (SELECT r.range AS bin, coalesce(kmers, 0) AS kmers FROM range(0, {bins}) r LEFT JOIN found ON found.bin = r.range)"""


def _sql() -> dict[str, str]:
    out = {}
    out["base_class_counts"] = f"WITH {READS}, c AS (SELECT unnest(string_split(seq, '')) AS c FROM reads) SELECT CASE WHEN upper(c) IN ('A','C','G','T') THEN upper(c) ELSE 'other' END AS base, count(*) AS n FROM c WHERE c <> '' GROUP BY 1"
    out["acgt_runs"] = f"WITH {READS}, {RUNS} SELECT id AS doc_id, count(*) AS n_runs, max(length(run)) AS longest FROM runs GROUP BY id"
    out["short_run_filter"] = f"WITH {READS}, {RUNS} SELECT length(run) AS run_length, count(*) AS n FROM runs WHERE length(run) >= 28 GROUP BY 1"
    out["kmers_per_doc"] = windows_sql(28) + " SELECT id AS doc_id, count(*) AS n_kmers, count(DISTINCT kmer) AS n_distinct FROM kmers GROUP BY id"
    out["revcomp_runs"] = f"WITH {READS}, {RUNS} SELECT DISTINCT id AS doc_id, translate(reverse(run), 'ACGT', 'TGCA') AS rc FROM runs WHERE length(run) >= 28"
    out["palindromes_even_k"] = counts_sql(8) + " SELECT kmer, cnt FROM counts WHERE kmer = translate(reverse(kmer), 'ACGT', 'TGCA')"
    hist = counts_sql(12) + ", h AS (SELECT CASE WHEN cnt < 512 THEN cnt ELSE 0 END AS bucket, count(*) AS n FROM counts GROUP BY 1), hist AS (SELECT r.range AS bucket, coalesce(n, 0) AS n_kmers FROM range(0, 512) r LEFT JOIN h ON h.bucket = r.range)"
    out["histogram_512"] = hist + " SELECT bucket, n_kmers FROM hist"
    out["histogram_csv_lines"] = hist + " SELECT CASE WHEN bucket = 0 THEN 512 ELSE bucket END AS ord, CASE WHEN bucket = 0 THEN '>=512; ' || lpad(n_kmers::VARCHAR, 9, ' ') ELSE '  ' || lpad(bucket::VARCHAR, 3, ' ') || '; ' || lpad(n_kmers::VARCHAR, 9, ' ') END AS line FROM hist UNION ALL SELECT 0, 'counter; number of uk-mers'"
    out["summary_totals"] = counts_sql(28) + " SELECT coalesce(sum(cnt), 0)::BIGINT AS kmers, count(*) AS ukmers, count(*) FILTER (WHERE cnt < 3) AS below_threshold FROM counts"
    out["base_totals"] = f"WITH {READS}, {RUNS}, t AS (SELECT sum(length(run)) AS b, sum(greatest(length(run) - 27, 0)) AS n FROM runs) SELECT (SELECT count(*) FROM reads) AS reads, coalesce(b, 0)::BIGINT AS bases, coalesce(n, 0)::BIGINT AS kmers FROM t"
    code = "list_sum([(position(substr(kmer, j::INT, 1) IN 'ACGT') - 1) * (1::BIGINT << (2 * (12 - j))::INT) FOR j IN range(1, 13)])::BIGINT"
    out["kmer_packed_code"] = counts_sql(12, 3) + f" SELECT kmer, {code} AS code, cnt FROM counts"
    byte = "printf('%02X', list_sum([(position(substr(rpad(kmer, 12, 'A'), (4 * q + j)::INT, 1) IN 'ACGT') - 1) * (1 << (2 * (4 - j))::INT) FOR j IN range(1, 5)])::BIGINT)"
    little = "'FF' || printf('%02X', cnt & 255) || printf('%02X', (cnt >> 8) & 255) || printf('%02X', (cnt >> 16) & 255) || printf('%02X', (cnt >> 24) & 255)"
    out["packed_record_hex"] = counts_sql(10, 3) + f" SELECT kmer, (CASE WHEN cnt < 255 THEN printf('%02X', cnt) ELSE {little} END) || list_aggregate([{byte} FOR q IN range(0, 3)], 'string_agg', '') AS record FROM counts"
    out["packed_roundtrip"] = counts_sql(33, 3) + " SELECT kmer, cnt FROM counts"
    out["fasta_lines"] = counts_sql(28, 3) + " SELECT '>' || cnt || chr(10) || kmer AS line FROM counts"
    for name, m, bins in (("minimizer_rank_m5", 5, BINS), ("minimizer_rank_m7", 7, 512)):
        out[name] = counts_sql(m) + f", {_ranks_sql(m, bins)} SELECT mmer, allowed, rnk, bin, coalesce(cnt, 0) AS n FROM ranks LEFT JOIN counts ON kmer = mmer"
    out["kmers_per_bin"] = _bins_sql() + " SELECT bin, kmers FROM stats"
    canon = "least(substr(run, i::INT, 28), translate(reverse(substr(run, i::INT, 28)), 'ACGT', 'TGCA'))"
    out["distinct_kmers_per_bin"] = _bins_sql() + f" SELECT bin, count(*) AS kmers, count(DISTINCT {canon}) AS ukmers FROM kb GROUP BY bin"
    q = BINS // 4
    ordered = f", o AS (SELECT *, row_number() OVER (ORDER BY kmers, bin) AS r FROM stats) SELECT bin, kmers, CASE WHEN r <= {q} THEN {q} + 1 - r ELSE r END AS ord FROM o"
    out["bin_order"] = _bins_sql() + ordered
    out["empty_bins_stats"] = _bins_sql(8, reads=f"reads AS (SELECT 0 AS id, {ADAPT.format('r_name')} AS seq FROM region)") + ordered
    out["bin_stats_file"] = _bins_sql() + f", u AS (SELECT bin, count(DISTINCT {canon}) AS ukmers FROM kb GROUP BY bin) SELECT bin, kmers, coalesce(ukmers, 0) AS ukmers FROM stats LEFT JOIN u USING (bin)"
    out["bin_size_stats"] = _bins_sql() + " SELECT count(*) AS n_bins, min(kmers) AS min_kmers, max(kmers) AS max_kmers, round(avg(kmers), 6) AS avg_kmers, round(stddev_samp(kmers), 4) AS sd_kmers, sum(kmers)::BIGINT AS sum_kmers FROM stats"
    out["supermers_by_bin"] = _bins_sql() + " SELECT bin, kmers, kmers AS by_length FROM found"
    for name in ("staged_equals_direct", "fastx_roundtrip", "fasta_bzip2_roundtrip", "fastq_roundtrip", "fastq_gzip_roundtrip", "lines_gzip_roundtrip", "packed_file_roundtrip"):
        out[name] = counts_sql(28, 3) + " SELECT kmer, cnt FROM counts"
    out["packed_to_fasta_lines"], out["histogram_file"] = out["fasta_lines"], out["histogram_csv_lines"]
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    out["file_type_detection"] = f"""WITH v AS (SELECT doc_id, 'in/' || source || '.' || {names}[(doc_id % {len(NAMES)} + 1)::INT] AS name FROM documents),
c AS (SELECT doc_id, name, CASE WHEN name LIKE '%.gz' THEN 'gzip' WHEN name LIKE '%.bz2' THEN 'bzip2' ELSE 'none' END AS codec, regexp_extract(regexp_replace(name, '\\.(gz|bz2)$', ''), '\\.([^./]*)$', 1) AS ext FROM v)
SELECT doc_id, name, CASE WHEN ext IN ('fastq', 'fq') THEN 'fastq' WHEN ext IN ('fasta', 'fa') THEN 'fasta' WHEN ext = 'ml' THEN 'lines' ELSE 'unknown' END AS type, codec FROM c"""
    out["auto_minimizer_length"] = "WITH v AS (SELECT doc_id, (n_chars % 4095 + 2)::BIGINT AS bins FROM documents), s AS (SELECT doc_id, bins, (ceil((floor(log2(bins)) + 1) / 2))::BIGINT AS m FROM v) SELECT doc_id, bins, greatest(5, CASE WHEN m >= 9 THEN m ELSE least(m + 2, 9) END)::BIGINT AS m FROM s"
    for name in ("fastq_multiline_roundtrip", "fasta_ranges_roundtrip", "path_list_count", "gzip_blocks_roundtrip", "packed_append_twice", "count_only", "refined_bins_count"):
        out[name] = counts_sql(28, 3) + " SELECT kmer, cnt FROM counts"
    out["second_phase_alone"] = counts_sql(28, 10) + " SELECT kmer, cnt FROM counts"
    out["job_totals"] = counts_sql(28) + ", b AS (SELECT (SELECT count(*) FROM reads) AS reads, (SELECT coalesce(sum(length(run)), 0) FROM runs)::BIGINT AS bases) SELECT reads, bases, coalesce(sum(cnt), 0)::BIGINT AS kmers, count(cnt) AS ukmers, count(*) FILTER (WHERE cnt < 3) AS below_threshold FROM b LEFT JOIN counts ON true GROUP BY reads, bases"
    both = f"reads AS (SELECT 0 AS id, {ADAPT.format('text')} AS seq FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations))"
    out["counts_that_grow"] = counts_sql(28, 3, reads=both) + " SELECT kmer, cnt FROM counts"
    union = f"reads AS (SELECT 0 AS id, {ADAPT.format('text')} AS seq FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations))"
    out["multi_source_union_count"] = counts_sql(28, 3, reads=union) + " SELECT kmer, cnt FROM counts"
    events = "reads AS (SELECT user_id AS id, string_agg(CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END, '' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
    out["event_sequence_kmers"] = counts_sql(8, 1, reads=events) + " SELECT kmer, cnt FROM counts"
    base = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'C' WHEN 'RF' THEN 'G' WHEN 'RO' THEN 'T' ELSE 'N' END"
    items = f"reads AS (SELECT l_partkey AS id, string_agg(b, '' ORDER BY l_orderkey, l_linenumber, b) AS seq FROM (SELECT l_partkey, l_orderkey, l_linenumber, {base} AS b FROM lineitem) GROUP BY l_partkey)"
    out["lineitem_sequence_kmers"] = counts_sql(8, 1, reads=items) + " SELECT kmer, cnt FROM counts"
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        base_class_counts, acgt_runs, short_run_filter, kmers_per_doc, revcomp_runs, palindromes_even_k, histogram_512, histogram_csv_lines, summary_totals, base_totals, kmer_packed_code,
        packed_record_hex, packed_roundtrip, fasta_lines, minimizer_rank_m5, minimizer_rank_m7, kmers_per_bin, distinct_kmers_per_bin, bin_order, bin_size_stats, supermers_by_bin, staged_equals_direct,
        file_type_detection, auto_minimizer_length, multi_source_union_count, event_sequence_kmers, lineitem_sequence_kmers, fastx_roundtrip, fasta_bzip2_roundtrip, fastq_roundtrip, fastq_gzip_roundtrip,
        lines_gzip_roundtrip, packed_file_roundtrip, packed_to_fasta_lines, histogram_file, bin_stats_file, empty_bins_stats,
        fastq_multiline_roundtrip, fasta_ranges_roundtrip, path_list_count, gzip_blocks_roundtrip, packed_append_twice, count_only, job_totals, second_phase_alone, refined_bins_count, counts_that_grow,
    )
    return _kmer_queries()[0] | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return _kmer_queries()[1] | _sql()
