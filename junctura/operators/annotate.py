"""Genes at both ends, known pairs, artefact intervals: joins with dimension tables.

Overlapping intervals are first turned into stretches that don't overlap, each with the interval that wins
there, so an end finds one row at most and its call keeps its place: calls are read once and never joined
with themselves. Spark broadcasts the stretches by their size; beyond its threshold the same joins are
shuffled on contig and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.contigs import strip_chr

PAD = 5000
BIN = 100_000


def stretches(intervals: DataFrame, pad: int, *kept: str) -> DataFrame:
    """chrom, bin, low, high, own start and stop, ``kept``: where each interval is the first (by start, then
    file order) of those that hold a place. intervals: chrom, start, stop, ord, ``kept``.

    In a bin, an interval that ends before an earlier one does never wins; the others win from where the
    one before ends, so one running maximum is enough.
    """
    low, high = F.col("start") - pad, F.col("stop") + pad
    rows = intervals.select("chrom", "start", "stop", "ord", *kept).withColumn("bin", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))
    earlier = W.partitionBy("chrom", "bin").orderBy("start", "ord").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("low", F.greatest(low, F.max(high).over(earlier) + 1)).withColumn("high", high)
    return rows.filter("low <= high").select("chrom", "bin", "low", "high", "start", "stop", *kept)


def with_first(calls: DataFrame, found: DataFrame, chrom: Column, pos: Column, columns: dict[str, Column]) -> DataFrame:
    """``calls`` with ``columns``, made of the stretch that holds ``chrom`` and ``pos`` (null without one)."""
    names = {n: f"hit_{n}" for n in found.columns}
    found = found.withColumnsRenamed(names)
    calls = calls.withColumn("hit_at", F.struct(strip_chr(chrom).alias("chrom"), F.floor(pos / BIN).alias("bin")))
    on = (F.col("hit_at.chrom") == F.col("hit_chrom")) & (F.col("hit_at.bin") == F.col("hit_bin")) & (pos >= F.col("hit_low")) & (pos <= F.col("hit_high"))
    return calls.join(found, on, "left").withColumns(columns).drop("hit_at", *names.values())


def region(pos: Column) -> Column:
    """Where ``pos`` lies with respect to the stretch's own interval."""
    start, stop = F.col("hit_start"), F.col("hit_stop")
    return F.when(start.isNull(), "intergenic").when((pos >= start) & (pos <= stop), "exonic_or_intronic").when(pos < start, "upstream").otherwise("downstream")


def pair_key(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")))


def known_pairs(partners: DataFrame) -> DataFrame:
    """x, y, kp_source: of repeated pairs the first in file order."""
    source = F.trim(F.concat_ws(":", "source", "disease"), F.lit(":"))
    key = pair_key(F.col("partner_a"), F.col("partner_b"))
    return partners.withColumn("key", key).groupBy("key.x", "key.y").agg(F.min_by(source, F.col("ord")).alias("kp_source"))


def annotated(calls: DataFrame, loci: DataFrame, partners: DataFrame) -> DataFrame:
    """Adds gene_a, gene_b, region_a, region_b, driver_locus, known_partner, known_partner_source, role_a, role_b."""
    out = calls.drop("gene_a", "gene_b", "region_a", "region_b", "role_a", "role_b", "driver_locus", "known_partner", "known_partner_source")
    found = stretches(loci, PAD, "gene", "role")
    for s in "ab":
        pos = F.col(f"pos_{s}")
        columns = {f"gene_{s}": F.coalesce("hit_gene", F.lit("")), f"role_{s}": F.col("hit_role"), f"region_{s}": region(pos)}
        out = with_first(out, found, F.col(f"chrom_{s}"), pos, columns)
    label = lambda s: F.when(F.col(f"role_{s}").isin("driver", "IG_locus"), F.col(f"gene_{s}"))
    out = out.withColumn("driver_locus", F.concat_ws("-", label("a"), label("b")))
    x, y = F.least("gene_a", "gene_b"), F.greatest("gene_a", "gene_b")
    pairs = known_pairs(partners)
    out = out.withColumn("x", F.when((F.col("gene_a") != "") & (F.col("gene_b") != ""), x)).withColumn("y", y).join(pairs, ["x", "y"], "left").drop("x", "y")
    return out.withColumn("known_partner", F.col("kp_source").isNotNull()).withColumn("known_partner_source", F.coalesce("kp_source", F.lit(""))).drop("kp_source")


def with_hits(calls: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """``calls`` with ``name``: whether either end lies in an interval."""
    found = stretches(intervals.withColumn("ord", F.lit(0)), 0)
    for s in "ab":
        calls = with_first(calls, found, F.col(f"chrom_{s}"), F.col(f"pos_{s}"), {f"in_{s}": F.col("hit_low").isNotNull()})
    return calls.withColumn(name, F.col("in_a") | F.col("in_b")).drop("in_a", "in_b")
