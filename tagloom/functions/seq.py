"""Sequence, name and strand columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("clean", "reverse", "complement", "reverse_complement", "rna", "dna")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seq_transform(c: Column | str, mode: str) -> Column:
    """One of MODES over an upper-case sequence: clean strips blanks, rna and dna swap T and U."""
    s = F.upper(F.trim(_c(c)))
    pairs = {"complement": ("ATGCU", "TACGA"), "reverse_complement": ("ATGCU", "TACGA"), "rna": ("T", "U"), "dna": ("U", "T")}
    if mode in ("reverse", "reverse_complement"):
        s = F.reverse(s)
    return F.translate(s, *pairs[mode]) if mode in pairs else s


def norm_tag(c: Column | str) -> Column:
    """Upper case, U to T, without gaps."""
    return F.translate(F.upper(_c(c)), "U-", "T")


def clean_header(c: Column | str) -> Column:
    """The first field, up to a bar, of the first token."""
    return F.substring_index(F.substring_index(F.regexp_replace(_c(c), "^>", ""), " ", 1), "|", 1)


def norm_strand(c: Column | str) -> Column:
    """w and c to + and -."""
    return F.translate(_c(c), "wc", "+-")


def norm_chr(c: Column | str) -> Column:
    """All but digits removed."""
    return F.regexp_replace(_c(c), "[^0-9]", "")


def locus_key(chrom: Column, strand: Column, start: Column, end: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, chrom.cast("string"), strand, start.cast("string"), end.cast("string"))


def parse_locus_id(c: Column | str) -> Column:
    """name_strand_chr:start:end as a struct (name, strand, chr, start, end)."""
    part = lambda k: F.regexp_extract(_c(c), r"^([^_]+)_([wc])_([^:]+):(\d+):(\d+)$", k)
    return F.struct(part(1).alias("name"), part(2).alias("strand"), part(3).alias("chr"), part(4).try_cast("bigint").alias("start"), part(5).try_cast("bigint").alias("end"))


def base_count(c: Column | str, margin: int = 0) -> Column:
    """Characters other than N, of the sequence without margin characters at both ends."""
    s = _c(c)
    if margin:
        s = F.substring(s, F.lit(margin + 1), F.greatest(F.length(s) - 2 * margin, F.lit(0)))
    return F.length(s) - F.length(s) + F.length(F.replace(s, F.lit("N"), F.lit("")))
