"""Rewrite passes over annotated calls, in their fixed order. Each is a DataFrame from a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contigs import is_decoy
from .annotate import with_hits
from .cluster import appended

#: Genes with physiological short-range breaks, antigen-receptor loci, event classes.
SHORT_RANGE_EXEMPT = (
    "BCL6", "BCL7A", "BTG1", "BTG2", "MYC", "PAX5", "PIM1", "CXCR4", "IRF4", "RHOH", "ST6GAL1", "SOCS1", "REL", "CIITA",
)
RECEPTOR_LOCI = ("IGH", "IGK", "IGL", "IGH_Emu", "IGH_3RR", "TRA", "TRB", "TRG", "TRD")
PHYSIOLOGICAL = ("IG_intra", "IG_IG", "driver_intra")
CLINICAL = ("IG_driver_canonical", "IG_driver_novel", "driver_driver", "driver_intergenic")


def rewritten(calls: DataFrame, when: Column, flag: str, tier: Column | None = None) -> DataFrame:
    """Flag (once) and tier of the rows where ``when`` holds."""
    new = {"qc_flags": appended(F.col("qc_flags"), when, flag)}
    if tier is not None:
        new["tier"] = F.when(when, tier).otherwise(F.col("tier"))
    return calls.withColumns(new)


def _has(flag: str) -> Column:
    return F.array_contains("qc_flags", flag)


def artefact_mask(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    return rewritten(with_hits(calls, intervals, "masked"), F.col("masked"), "builtin_artefact_locus", F.lit("T3")).drop("masked")


def hot_cells(calls: DataFrame, window: int = 500, min_partners: int = 10, min_chroms: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """chrom, cell (and ``by``): cells whose partners lie in many cells on several contigs."""
    a = F.struct(F.col("chrom_a").alias("chrom"), F.floor(F.col("pos_a") / window).alias("cell"))
    b = F.struct(F.col("chrom_b").alias("chrom"), F.floor(F.col("pos_b") / window).alias("cell"))
    both = calls.select(*by, F.explode(F.array(F.struct(a.alias("at"), b.alias("to")), F.struct(b.alias("at"), a.alias("to")))).alias("p")).select(*by, "p.at", "p.to")
    by = both.distinct().groupBy(*by, "at.chrom", "at.cell").agg(F.count("*").alias("partners"), F.countDistinct("to.chrom").alias("chroms"))
    return by.filter((F.col("partners") >= min_partners) & (F.col("chroms") >= min_chroms)).select(*by, "chrom", "cell")


def recurrent(calls: DataFrame, window: int = 500, min_partners: int = 10, min_chroms: int = 3, lower: bool = False, by_sample: bool = False) -> DataFrame:
    """Reads ``calls`` twice (for the hot cells, and to flag), so they should be written. Cells are hot by all calls, or each
    sample on its own."""
    by = ("sample",) if by_sample else ()
    hot = hot_cells(calls, window, min_partners, min_chroms, by).withColumn("hot", F.lit(True))
    out = calls
    for s in "ab":
        side = hot.select(F.col("chrom").alias(f"hc_{s}"), F.col("cell").alias(f"hp_{s}"), F.col("hot").alias(f"hot_{s}"), *[F.col(c).alias(f"hs_{s}") for c in by])
        same = (out[f"chrom_{s}"] == side[f"hc_{s}"]) & (F.floor(out[f"pos_{s}"] / window) == side[f"hp_{s}"])
        out = out.join(side, same & out["sample"].eqNullSafe(side[f"hs_{s}"]) if by_sample else same, "left")
    hit = F.coalesce("hot_a", "hot_b", F.lit(False))
    tier = F.when(F.col("tier") == "T1", "T2").when(F.col("tier") == "T2", "T3").otherwise(F.col("tier")) if lower else None
    return rewritten(out, hit, "recurrent_artefact", tier).drop("hc_a", "hp_a", "hot_a", "hc_b", "hp_b", "hot_b", "hs_a", "hs_b")


def short_range(calls: DataFrame, span: int = 200) -> DataFrame:
    near = (F.col("chrom_a") == F.col("chrom_b")) & (F.abs(F.col("pos_b") - F.col("pos_a")) < span)
    return rewritten(calls, near & ~F.col("gene_a").isin(*SHORT_RANGE_EXEMPT) & ~F.col("gene_b").isin(*SHORT_RANGE_EXEMPT), "short_range")


def masked_breakends(calls: DataFrame) -> DataFrame:
    return rewritten(calls, _has("builtin_artefact_locus"), "partner_undetermined", F.lit("T3"))


def promote_known(calls: DataFrame, least: int = 5, t1_split: int = 5, t1_pairs: int = 10) -> DataFrame:
    sr, pe = F.col("split_reads"), F.col("discordant_pairs")
    goal = F.when((sr >= t1_split) | (pe >= t1_pairs), "T1").otherwise("T2")
    return rewritten(calls, F.col("known_partner") & (sr + pe >= least) & (goal < F.col("tier")), "promoted_known_partner", goal)


def classified(calls: DataFrame, receptors: tuple[str, ...] | None = None) -> DataFrame:
    """Adds event_class. ``receptors``: genes of receptor loci; None takes the role of the locus instead."""
    ig = lambda s: F.coalesce(F.col(f"role_{s}") == "IG_locus", F.lit(False)) if receptors is None else F.col(f"gene_{s}").isin(*receptors)
    drv = lambda s: F.coalesce(F.col(f"role_{s}") == "driver", F.lit(False))
    same = F.col("gene_a") == F.col("gene_b")
    one_driver = F.when(ig("a"), drv("b")).otherwise(drv("a"))
    return calls.withColumn(
        "event_class",
        F.when(ig("a") & ig("b"), F.when(same, "IG_intra").otherwise("IG_IG"))
        .when(ig("a") | ig("b"), F.when(one_driver, F.when(F.col("known_partner"), "IG_driver_canonical").otherwise("IG_driver_novel")).otherwise("IG_intergenic"))
        .when(drv("a") & drv("b"), F.when(same, "driver_intra").otherwise("driver_driver"))
        .when(drv("a") | drv("b"), "driver_intergenic").otherwise("intergenic"),
    )


def demote_nonclinical(calls: DataFrame, tier: str = "T3") -> DataFrame:
    when = (F.col("tier") == "T1") & ~F.col("known_partner") & ~((F.col("n_callers") >= 2) & F.col("any_pass"))
    return rewritten(calls, when & (F.col("event_class").isin(*PHYSIOLOGICAL) | _has("recurrent_artefact")), "demoted_nonclinical_t1", F.lit(tier))


def decoy(calls: DataFrame) -> DataFrame:
    exempt = F.col("known_partner") & (F.col("gene_a") != "") & (F.col("gene_b") != "")
    when = (F.col("tier") != "T3") & ~exempt & (is_decoy(F.col("chrom_a")) | is_decoy(F.col("chrom_b")))
    return rewritten(calls, when, "decoy_partner", F.lit("T3"))


def demote_physiological(calls: DataFrame) -> DataFrame:
    noise = F.col("event_class").isin(*PHYSIOLOGICAL) | (_has("recurrent_artefact") & F.col("event_class").isin("IG_intergenic", "intergenic"))
    when = F.col("tier").isin("T1", "T2") & ~F.col("known_partner") & ~F.col("event_class").isin(*CLINICAL) & noise
    return rewritten(calls, when, "demoted_review_noise", F.lit("T3"))


def demote_without_pairs(calls: DataFrame, least: int = 1) -> DataFrame:
    when = F.col("tier").isin("T1", "T2") & (F.col("chrom_a") != F.col("chrom_b")) & (F.col("discordant_pairs") < least) & (F.col("assembly_contigs") == 0)
    return rewritten(calls, when, "no_discordant_support", F.lit("T3"))


def gate_actionable(calls: DataFrame) -> DataFrame:
    pair = (F.col("gene_a") != "") & (F.col("gene_b") != "") & (F.col("gene_a") != F.col("gene_b")) & F.col("known_partner")
    return rewritten(calls, (F.col("tier") == "T1") & ~pair & (F.col("n_callers") < 2), "t1_capped_unresolved", F.lit("T2"))


def passes(intervals: DataFrame, receptors: tuple[str, ...] | None = None, by_sample: bool = False) -> list:
    """The passes in their order."""
    return [
        lambda d: artefact_mask(d, intervals), lambda d: recurrent(d, by_sample=by_sample), short_range, masked_breakends, promote_known, lambda d: classified(d, receptors),
        demote_nonclinical, decoy, demote_physiological, demote_without_pairs, gate_actionable,
    ]


def checked(calls: DataFrame, intervals: DataFrame, receptors: tuple[str, ...] | None = None, by_sample: bool = False) -> DataFrame:
    return reduce(lambda d, f: f(d), passes(intervals, receptors, by_sample), calls)


def rescue_partners(*_: object, **__: object) -> None:
    raise NotImplementedError("partners are never inferred: no call is made without evidence of both ends")


infer_chromosomes = rescue_partners
