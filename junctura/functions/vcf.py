"""Parsing and building the fields of variant records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a breakend's ALT.
BND = r"(?i)([ACGTN.]*)([\[\]])([^:\[\]]+):(\d+)([\[\]])([ACGTN.]*)"
#: Strands by orientation code.
CT_STRANDS = {"3to5": ("+", "-"), "5to3": ("-", "+"), "3to3": ("+", "+"), "5to5": ("-", "-")}


def last_of_each(entries: Column) -> Column:
    """A map of entries (key, value); of repeated keys the last counts. Later entries are searched only where
    a key repeats."""
    several = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) < F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.when(several, last).otherwise(entries))


def info_entries(info: Column) -> Column:
    """Entries (key, value) of INFO: flags are "1" (a lone dot, too), empty parts are skipped."""
    parts = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda p: p != "")
    at = lambda p: F.locate("=", p)
    entry = lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), p.substr(at(p) + 1, F.length(p))).otherwise(F.lit("1")).alias("value"),
    )
    return F.transform(parts, entry)


def info_map(info: Column) -> Column:
    """INFO as a map of ``info_entries``; of repeated keys the last counts."""
    return last_of_each(info_entries(info))


def format_entries(keys: Column, values: Column) -> Column:
    """Entries (key, value) of FORMAT and the first sample, as far as the shorter one goes."""
    k, v = F.split(F.coalesce(keys, F.lit("")), ":"), F.split(F.coalesce(values, F.lit("")), ":")
    n = F.least(F.size(k), F.size(v))
    pairs = F.arrays_zip(F.slice(k, F.lit(1), n).alias("key"), F.slice(v, F.lit(1), n).alias("value"))
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))


def format_map(keys: Column, values: Column) -> Column:
    """FORMAT and the first sample as a map of ``format_entries``; of repeated keys the last counts."""
    return last_of_each(format_entries(keys, values))


def to_int(x: Column) -> Column:
    """Whole number of a text, through a decimal number if need be, else 0."""
    return F.coalesce(x.try_cast("bigint"), F.floor(x.try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def to_float(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def element(text: Column, k: int) -> Column:
    """Element of a list with commas, from 1, or from the end if negative; null where there is none."""
    return F.try_element_at(F.split(text, ","), F.lit(k))


def interval(text: Column) -> Column:
    """A confidence interval as struct(lo, hi); (0, 0) where it can't be read."""
    lo, hi = element(text, 1).try_cast("int"), element(text, 2).try_cast("int")
    good = lo.isNotNull() & hi.isNotNull() & (F.size(F.split(text, ",")) == 2)
    return F.struct(F.when(good, lo).otherwise(0).alias("lo"), F.when(good, hi).otherwise(0).alias("hi"))


def bnd(alt: Column) -> Column:
    """struct(chrom, pos, strand_a, strand_b) of a breakend's ALT, null where it isn't one."""
    part = [F.regexp_extract(alt, BND, i) for i in range(7)]
    before, after = part[1] != "", part[6] != ""
    good = (part[0] != "") & (part[2] == part[5]) & (before != after)
    strand_b = F.when(part[2] == "[", "+").otherwise("-")
    return F.when(good, F.struct(part[3].alias("chrom"), part[4].try_cast("bigint").alias("pos"), F.when(before, "+").otherwise("-").alias("strand_a"), strand_b.alias("strand_b")))


def alt_of(strand_a: Column, strand_b: Column, chrom: Column, pos: Column) -> Column:
    """ALT of a breakend; unknown strands are written as + +."""
    at = F.concat(chrom, F.lit(":"), pos.cast("string"))
    wrap = lambda a, b, c, d: F.concat(F.lit(a), F.lit(b), at, F.lit(c), F.lit(d))
    return (
        F.when((strand_a == "+") & (strand_b == "-"), wrap("N", "]", "]", ""))
        .when((strand_a == "-") & (strand_b == "+"), wrap("", "[", "[", "N"))
        .when((strand_a == "-") & (strand_b == "-"), wrap("", "]", "]", "N"))
        .otherwise(wrap("N", "[", "[", ""))
    )


def percent(text: Column) -> Column:
    """Percent-encoding of the characters that INFO reserves, the percent sign first."""
    for ch in "%;=, \t\n\r":
        text = F.replace(text, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return text
