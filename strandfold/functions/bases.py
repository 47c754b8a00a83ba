"""Nucleotide expressions. Bases are A, C, G, T in either case; every other character breaks a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGT", "TGCA"
# The adapter from text to bases used by the registered queries.
TEXT_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,"
TEXT_TO = ("ACGT" * 14)[:55]


def from_text(text: Column) -> Column:
    """Bases of any text: each known character stands for one base, others stay and break runs."""
    return F.translate(text, TEXT_FROM, TEXT_TO)


def runs(seq: Column) -> Column:
    """array<string>: the maximal runs of bases, in upper case."""
    return F.transform(F.regexp_extract_all(seq, F.lit("([ACGTacgt]+)"), F.lit(1)), F.upper)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENTS)


def packed_code(kmer: Column) -> Column:
    """BIGINT of at most 31 bases, two bits each, the first base highest."""
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("bigint")


def from_code(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


def packed_hex(kmer: Column, k: int) -> Column:
    """Hex of ceil(k/4) bytes: four bases a byte, the first highest, padded with zero bits."""
    width = -(-k // 4) * 4
    digits = F.translate(F.rpad(kmer, width, "A"), BASES, "0123")
    parts = [F.lpad(F.conv(F.substring(digits, i + 1, 4), 4, 16), 2, "0") for i in range(0, width, 4)]
    return F.concat(*parts)


def from_packed_hex(packed: Column, k: int) -> Column:
    parts = [F.lpad(F.conv(F.substring(packed, i + 1, 2), 16, 4), 4, "0") for i in range(0, -(-k // 4) * 2, 2)]
    return F.substring(F.translate(F.concat(*parts), "0123", BASES), 1, k)


def record_hex(count: Column, kmer: Column, k: int) -> Column:
    """A packed record: one count byte below 255, else FF and 32 bits little-endian; then the packed k-mer. The format has no
    larger count than 2^32 - 1, which stands for all beyond."""
    h = F.lpad(F.hex(F.least(count, F.lit((1 << 32) - 1))), 8, "0")
    little = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.concat(F.when(count < 255, F.substring(h, 7, 2)).otherwise(F.concat(F.lit("FF"), little)), packed_hex(kmer, k))
