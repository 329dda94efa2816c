"""Contig names and the canonical order of a breakpoint's two ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: contigs that aren't part of the primary assembly.
DECOY = r"(?i)(_decoy|_random|_alt|^chrUn|^Un_|KI270|GL000|JTFH|KN707|HLA-|EBV)"


def strip_chr(chrom: Column) -> Column:
    return F.when(F.lower(F.left(chrom, F.lit(3))) == "chr", chrom.substr(4, 1 << 30)).otherwise(chrom)


def is_decoy(chrom: Column) -> Column:
    return chrom.rlike(DECOY)


def _bare_key(bare: Column) -> Column:
    number = bare.try_cast("int").isNotNull()
    return F.when(number & (F.length(bare) < 2), F.concat(F.lit("0"), bare)).when(number, bare).otherwise(F.concat(F.lit(":"), bare))  # a colon follows the digits


def chrom_key(chrom: Column) -> Column:
    """A text that sorts contigs: numbers first, two digits wide, then the others by name."""
    return _bare_key(strip_chr(chrom))


def _after(key1: Column, pos1: Column, key2: Column, pos2: Column) -> Column:
    return (key1 > key2) | ((key1 == key2) & (pos1 > pos2))


def ordered(chrom1: Column, pos1: Column, strand1: Column, chrom2: Column, pos2: Column, strand2: Column) -> dict[str, Column]:
    """chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b: the lesser end first, whole ends swapped."""
    return _picked(_after(chrom_key(chrom1), pos1, chrom_key(chrom2), pos2), chrom1, pos1, strand1, chrom2, pos2, strand2)


def _picked(swap: Column, chrom1: Column, pos1: Column, strand1: Column, chrom2: Column, pos2: Column, strand2: Column) -> dict[str, Column]:
    pick = lambda x, y: F.when(swap, y).otherwise(x)
    return {
        "chrom_a": pick(chrom1, chrom2), "pos_a": pick(pos1, pos2), "strand_a": pick(strand1, strand2),
        "chrom_b": pick(chrom2, chrom1), "pos_b": pick(pos2, pos1), "strand_b": pick(strand2, strand1),
    }


def with_ends(df: DataFrame, chrom1: Column, pos1: Column, strand1: Column, chrom2: Column, pos2: Column, strand2: Column) -> DataFrame:
    """``df`` with the six columns of ``ordered``. Bare names, keys and whether ends are swapped are columns one after
    the other, so each is worked out once a row and the generated code stays short. (A filter on the result takes them
    apart again: write the ends before they are filtered or joined with themselves.)"""
    df = df.withColumns({"bare_1": strip_chr(chrom1), "bare_2": strip_chr(chrom2)})
    df = df.withColumns({f"key_{k}": _bare_key(F.col(f"bare_{k}")) for k in (1, 2)})
    df = df.withColumn("ends_swapped", _after(F.col("key_1"), pos1, F.col("key_2"), pos2))
    df = df.withColumns(_picked(F.col("ends_swapped"), chrom1, pos1, strand1, chrom2, pos2, strand2))
    return df.drop("bare_1", "bare_2", "key_1", "key_2", "ends_swapped")


def as_named(df: DataFrame, chrom: str, contigs: DataFrame) -> DataFrame:
    """``df`` with ``chrom`` as the one column of ``contigs`` names it, with or without chr; rows of contigs that aren't
    there are left out, and one that is there by both names comes twice. Names are made distinct where they lie."""
    names = contigs.toDF("contig_name").distinct().withColumn("contig_bare", strip_chr(F.col("contig_name")))
    out = df.join(names, strip_chr(F.col(chrom)) == F.col("contig_bare"))
    return out.select(*[F.col("contig_name").alias(c) if c == chrom else F.col(c) for c in df.columns])


def sort_rank(chrom: Column) -> Column:
    """Order of contigs in variant files: numbers, X, Y, M, then the rest by name."""
    bare = strip_chr(chrom)
    rank = (
        F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
        .when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(1000)
    )
    return F.struct(rank.alias("rank"), F.when(rank == 1000, bare).otherwise(F.lit("")).alias("name"))
