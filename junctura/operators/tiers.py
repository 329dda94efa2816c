"""Provisional tiers of clusters, ids, and the log-likelihood score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import numbered
from .cluster import appended

LOW_QUALITY = 0.0


def tiered(clusters: DataFrame) -> DataFrame:
    """Adds tier and qc_flags; the first rule that fits gives the tier."""
    n, sr, pe, asm = F.col("n_callers"), F.col("split_reads"), F.col("discordant_pairs"), F.col("assembly_contigs")
    ok, exact, kinds = F.col("any_pass"), F.col("precise"), F.col("n_evidence_types")
    loose = (n == 1) & ~exact
    several = (n >= 2) & ok & (sr >= 3) & (kinds >= 2) & exact & ~loose
    strongest = (n == 1) & ok & exact & (sr >= 10) & (pe >= 10) & (kinds >= 2)
    strong = (n == 1) & ok & (sr >= 5) & (asm >= 1)
    medium = (n == 1) & ok & (sr >= 5)
    tier = F.when(several | strongest, "T1").when((n >= 2) | strong | medium, "T2").otherwise("T3")
    extra = F.when(several, None).when(strongest, "single_caller_very_strong").when(n >= 2, None).when(strong, "single_caller_strong").when(medium, "single_caller_medium")
    flags = F.array(F.when(loose, "singleton_imprecise"), F.when(F.col("raw_qual_max") < LOW_QUALITY, "low_quality"), extra)
    return clusters.withColumn("tier", tier).withColumn("qc_flags", F.filter(flags, lambda x: x.isNotNull()))


def with_ids(calls: DataFrame) -> DataFrame:
    """Adds fusion_id: the sample, both ends, and the cluster's place in its sample, by first member."""
    name = F.format_string("%s__%s_%d_%s__%s_%d_%s__%05d", "sample", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", F.col("place"))
    return numbered(calls, ["sample"], ["first_seq"], "place").withColumn("fusion_id", name).drop("place")


def llr(calls: DataFrame) -> DataFrame:
    """Adds llr: evidence, capped, with what speaks for and against the event; 0 at least."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c, points: F.when(c, F.lit(points)).otherwise(F.lit(0.0))
    score = (
        F.least(num("split_reads"), F.lit(30)) * 4.0 + F.least(num("discordant_pairs"), F.lit(30)) * 1.8 + yes(num("assembly_contigs") > 0, 20.0)
        + F.when(F.col("n_callers") >= 2, (F.col("n_callers") - 1) * 10.0).otherwise(0.0) + yes(F.col("known_partner"), 30.0) + yes(F.col("precise"), 10.0)
        + yes(F.col("any_pass"), 5.0) + F.when(F.col("event_class").isin("IG_intra", "IG_IG"), -40.0).when(F.col("event_class") == "driver_intra", -25.0).otherwise(0.0)
        + yes(F.array_contains("qc_flags", "recurrent_artefact"), -60.0)
    )
    return calls.withColumn("llr", F.greatest(F.lit(0.0), score))


def promoted_by_llr(calls: DataFrame, t1: float = 100.0, t2: float = 50.0) -> DataFrame:
    """Raises tiers by the score, never lowers them."""
    calls = llr(calls)
    goal = F.when(F.col("llr") >= t1, "T1").when(F.col("llr") >= t2, "T2").otherwise("T3")
    up = goal < F.col("tier")
    flags = F.col("qc_flags")
    for new, old in (("T1", "T2"), ("T1", "T3"), ("T2", "T3")):
        flags = appended(flags, up & (goal == new) & (F.col("tier") == old), f"llr_promoted_{new}_from_{old}")
    return calls.select(*[c for c in calls.columns if c not in ("tier", "qc_flags")], F.when(up, goal).otherwise(F.col("tier")).alias("tier"), flags.alias("qc_flags"))
