"""Queries over the driver's tables; their SQL for DuckDB is in ``oracles``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import contigs, vcf
from ..operators import annotate, cluster, qc, reads, reports, tiers, truth
from ..sinks import vcf_out
from ..sources import adapters, callers
from ..sources.steps import written
from .oracles import ORACLES as ORACLES

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    raw = adapters.view(spark, sf, "raw_calls")
    ends = contigs.with_ends(raw, *[F.col(f"{c}{i}") for i in (1, 2) for c in ("chrom", "pos", "strand")])
    number = F.col("packed") if "packed" in raw.columns else F.col("call_seq").cast("string")
    return ends.withColumn("record_id", F.concat(F.lit("r"), number)).drop("packed", *[f"{c}{i}" for i in (1, 2) for c in ("chrom", "pos", "strand")])


def found(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.clusters(cluster.clustered(calls(spark, sf)))


def unlisted(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters for queries that don't read the lists of members."""
    return cluster.clusters(cluster.clustered(calls(spark, sf).drop("record_id")))


def called(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.with_ids(tiers.tiered(unlisted(spark, sf)))


def annotated(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Annotated calls of the clusters ``of``, or of ``unlisted``."""
    calls = called(spark, sf) if of is None else tiers.with_ids(tiers.tiered(of))
    return annotate.annotated(calls, adapters.view(spark, sf, "loci"), adapters.view(spark, sf, "partners"))


def qc_input(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Annotated calls, of which some are moved to a near position or to a decoy contig; written, as the passes
    read them twice."""
    s = F.col("first_seq")
    decoy, near = s % 11 == 0, (s % 11 != 0) & (s % 7 == 0)
    out = annotated(spark, sf, of)
    return written(out.withColumns(
        {
            "chrom_b": F.when(decoy, F.concat(F.lit("GL000"), (s % 9).cast("string"), F.lit(".1"))).when(near, F.col("chrom_a")).otherwise(F.col("chrom_b")),
            "pos_b": F.when(near, F.col("pos_a") + s % 400).otherwise(F.col("pos_b")),
        }
    ), "annotated")


def final(spark: SparkSession, sf: str) -> DataFrame:
    return qc.checked(qc_input(spark, sf), adapters.view(spark, sf, "artefacts"))


def final_with_members(spark: SparkSession, sf: str) -> DataFrame:
    whole = written(found(spark, sf), "clusters")
    out = qc.checked(qc_input(spark, sf, whole.drop("member_record_ids")), adapters.view(spark, sf, "artefacts"))
    return cluster.with_members(out, whole)


def held(df: DataFrame) -> DataFrame:
    """For queries that read the calls several times: written once and read again."""
    return written(df, "calls")


def _passed(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """After the first ``n`` passes."""
    steps = qc.passes(adapters.view(spark, sf, "artefacts"))[:n]
    return reduce(lambda d, f: f(d), steps, qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def provisional_tier(spark, sf):
    out = called(spark, sf)
    return out.select("cluster_id", "fusion_id", "tier", joined("qc_flags"))


@query
def breakpoint_order(spark, sf):
    return calls(spark, sf).select("call_seq", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b")


@query
def neighbour_pairs(spark, sf):
    ends = calls(spark, sf).select(*cluster.KEYS, "call_seq", "pos_a", "pos_b")
    return cluster.band_edges(written(ends, "ends"))  # both sides read them


@query
def components(spark, sf):
    return cluster.clustered(calls(spark, sf)).select("call_seq", "cluster_id")


@query
def components_unstranded(spark, sf):
    return cluster.clustered(calls(spark, sf), strands=False).select("call_seq", "cluster_id")


@query
def components_min_samples(spark, sf):
    return cluster.clustered(calls(spark, sf), min_samples=2).select("call_seq", "cluster_id")


@query
def grid_clusters(spark, sf):
    return cluster.grid_clustered(calls(spark, sf)).groupBy("cluster_id").agg(F.count("*").alias("members"))


@query
def cluster_representative(spark, sf):
    return found(spark, sf).select("cluster_id", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", joined("callers_supporting"), joined("member_record_ids"))


@query
def evidence_summary(spark, sf):
    return unlisted(spark, sf).select("cluster_id", "n_callers", "n_evidence_types", "split_reads", "discordant_pairs", "assembly_contigs", "soft_clips", "vaf", "raw_qual_max", "precise", "any_pass")


@query
def gene_annotation(spark, sf):
    return annotated(spark, sf).select("cluster_id", "gene_a", "gene_b", "driver_locus")


@query
def region_annotation(spark, sf):
    return annotated(spark, sf).select("cluster_id", "region_a", "region_b")


@query
def known_partner(spark, sf):
    return annotated(spark, sf).select("cluster_id", "known_partner", "known_partner_source")


@query
def qc_artefact(spark, sf):
    return _passed(spark, sf, 1)


@query
def qc_recurrent(spark, sf):
    return qc.recurrent(qc_input(spark, sf), 500, 3, 1, lower=True).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_short_range(spark, sf):
    return qc.short_range(qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_masked(spark, sf):
    return _passed(spark, sf, 4)


@query
def qc_promote(spark, sf):
    return qc.promote_known(qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def event_class(spark, sf):
    return qc.classified(qc_input(spark, sf)).select("fusion_id", "event_class")


@query
def qc_demote_t1(spark, sf):
    return qc.demote_nonclinical(qc.classified(qc_input(spark, sf))).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_decoy(spark, sf):
    return qc.decoy(qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_physiological(spark, sf):
    return qc.demote_physiological(qc.classified(qc_input(spark, sf))).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_discordant(spark, sf):
    return qc.demote_without_pairs(qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_gate(spark, sf):
    return qc.gate_actionable(qc_input(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def qc_full(spark, sf):
    return final(spark, sf).select("fusion_id", "tier", "event_class", joined("qc_flags"))


@query
def llr_score(spark, sf):
    return tiers.llr(final(spark, sf)).select("fusion_id", F.round("llr", 6).alias("llr"))


@query
def llr_promote(spark, sf):
    return tiers.promoted_by_llr(final(spark, sf)).select("fusion_id", "tier", joined("qc_flags"))


@query
def cohort_recurrence(spark, sf):
    return reports.cohort_recurrence(final(spark, sf))


@query
def recurrence_top(spark, sf):
    return reports.recurrence_top(held(final(spark, sf)))


@query
def per_sample_summary(spark, sf):
    return reports.per_sample(final(spark, sf))


@query
def kpis(spark, sf):
    return reports.kpis(held(final(spark, sf)))


@query
def caller_tier_pivot(spark, sf):
    return reports.caller_tiers(final(spark, sf))


@query
def qc_histograms(spark, sf):
    return reports.histograms(held(final(spark, sf)))


@query
def evidence_hist(spark, sf):
    return reports.evidence_histogram(held(final(spark, sf)))


@query
def locus_summary(spark, sf):
    return reports.locus_summary(final(spark, sf), adapters.view(spark, sf, "loci"))


@query
def physio_top(spark, sf):
    return reports.physiological_top(final(spark, sf))


@query
def novel_top(spark, sf):
    return reports.novel_top(final(spark, sf)).select("fusion_id", "tier", "event_class")


@query
def call_order(spark, sf):
    """The table of a sample's calls of the upper tiers, by tier, split reads and callers."""
    return reports.in_order(held(final(spark, sf)).filter("tier <> 'T3'")).select("sample", "fusion_id", "tier", "place")


@query
def between_receptors(spark, sf):
    return reports.between_receptors(final(spark, sf)).select("fusion_id", "gene_a", "gene_b")


@query
def receptor_counts(spark, sf):
    return reports.receptor_counts(final(spark, sf))


@query
def best_per_pair(spark, sf):
    return reports.best_per_pair(reports.translocations(final(spark, sf), _classes(spark, sf)))


@query
def arc_points(spark, sf):
    arcs = adapters.view(spark, sf, "metadata").select("sample_id", F.length("cell_line").alias("n")).select("sample_id", (F.col("n") * 0.1).alias("theta_1"), (F.col("n") * 0.35 + 1).alias("theta_2"))
    return reports.arc_points(arcs).select("sample_id", "step", F.round("theta", 6).alias("theta"), F.round("r", 6).alias("r"))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.view(spark, sf, "partners").filter("source <> 'later'")
    return p.select(F.col("partner_a").alias("gene_1"), F.col("partner_b").alias("gene_2"), F.concat(F.lit("t_"), F.col("source")).alias("class"), F.col("disease").alias("label"))


@query
def translocation_groups(spark, sf):
    return reports.translocations(final(spark, sf), _classes(spark, sf)).groupBy("class", "label", "tier").agg(F.count("*").alias("n"))


@query
def best_per_sample(spark, sf):
    return reports.best_per_sample(reports.translocations(final(spark, sf), _classes(spark, sf))).select("class", "sample", "fusion_id", "tier")


@query
def caller_jaccard(spark, sf):
    return reports.caller_jaccard(held(final(spark, sf))).withColumn("jaccard", F.round("jaccard", 6))


@query
def replicate_overlap(spark, sf):
    pairs = spark.createDataFrame([("S0", "S1"), ("S2", "S3"), ("S4", "S9")], "sample_1 string, sample_2 string")
    out = final(spark, sf).withColumn("pos_a", F.col("pos_a") - F.col("pos_a") % 100000).withColumn("pos_b", F.col("pos_b") - F.col("pos_b") % 50000)
    return reports.replicate_overlap(out, pairs).withColumn("jaccard", F.round("jaccard", 6))


@query
def pr_sweep(spark, sf):
    out = held(final(spark, sf))
    known = out.filter("first_seq % 3 = 0").select(*reports.cell_key(500, True))
    return reports.precision_recall(out, known).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query
def truth_per_sample(spark, sf):
    return truth.scored(held(final(spark, sf)), adapters.view(spark, sf, "truth")).drop("tp_detected", "tp_lookup")


@query
def truth_score(spark, sf):
    out = truth.summary(truth.scored(held(final(spark, sf)), adapters.view(spark, sf, "truth")))
    return out.select("tp", "fn", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def truth_relaxed(spark, sf):
    out = truth.scored(held(final(spark, sf)), adapters.view(spark, sf, "truth"), relax=True, driver_only=True, scanned_only=False, receptors=None)
    return out.select("sample", "tp", "fn", "fp", "exempt")


@query
def truth_junction_split(spark, sf):
    seen = adapters.view(spark, sf, "junctions").filter("sr_junction >= 2 or pe_junction >= 2")
    return truth.scored(held(final(spark, sf)), adapters.view(spark, sf, "truth"), seen, fp=("T1",)).select("sample", "tp", "fp", "tp_detected", "tp_lookup")


@query
def metadata_join(spark, sf):
    meta = adapters.view(spark, sf, "metadata").dropDuplicates(["sample_id"]).withColumn("lineage", reports.lineage(F.col("cohort")))
    counts = final(spark, sf).groupBy("sample").agg(F.count("*").alias("n"))
    return counts.join(meta, counts["sample"] == meta["sample_id"], "left").select("sample", "n", "cell_line", "lineage")


@query
def cohort_lineage(spark, sf):
    return adapters.view(spark, sf, "metadata").select("sample_id", reports.lineage(F.col("cohort")).alias("lineage"))


@query
def unreachable_pairs(spark, sf):
    """Known pairs of which a gene has no locus."""
    loci = adapters.view(spark, sf, "loci").select(F.col("gene").alias("g")).distinct()
    p = adapters.view(spark, sf, "partners")
    genes = p.select("ord", "partner_a", "partner_b", F.explode(F.array("partner_a", "partner_b")).alias("g"))
    return genes.join(loci, "g", "left_anti").select("ord", "partner_a", "partner_b").distinct()


@query
def ring_angles(spark, sf):
    """Sectors of the contigs, as long as their farthest end of a call."""
    ends = calls(spark, sf).select(F.explode(F.array(*[F.struct(F.col(f"chrom_{s}").alias("chrom"), F.col(f"pos_{s}").alias("pos")) for s in "ab"])).alias("end"))
    lengths = ends.groupBy("end.chrom").agg(F.max("end.pos").alias("length"))  # a row for each contig
    out = reports.ring_sectors(lengths.withColumn("ord", F.row_number().over(W.orderBy(contigs.chrom_key(F.col("chrom")))).cast("long")))
    return out.select("chrom", F.round("start_angle", 6).alias("start_angle"), F.round("stop_angle", 6).alias("stop_angle"))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """The reads as a table, which they are outside these queries: a filter would else work out the view's columns again
    for each of its parts."""
    return written(adapters.view(spark, sf, "reads"), "reads")


@query
def read_filter_weight(spark, sf):
    out = reads.usable(reads.in_windows(aligned(spark, sf), adapters.view(spark, sf, "windows"), rows=reads.ROWS_A_LOCUS), 10)  # its SQL states this number
    return out.select("gene", "read_id", F.round(reads.mapq_weight(F.col("mapq")), 6).alias("weight"))


@query
def clip_side(spark, sf):
    c, s = F.col("cigar"), F.col("seq")
    return adapters.view(spark, sf, "reads").select(
        "read_id", reads.clip_side(c).alias("side"), reads.clip_sequence(c, s).alias("clip"), reads.aligned_sequence(c, s).alias("aligned"),
        reads.hard_clipped(c).alias("hard"), reads.soft_clip_total(c).alias("soft_total"),
    )


@query
def noise_clip(spark, sf):
    return adapters.view(spark, sf, "reads").select("read_id", reads.read_is_noise(F.col("cigar"), F.col("seq")).alias("noise"), reads.is_noise(F.col("seq")).alias("whole_noise"))


@query
def sa_explode(spark, sf):
    return adapters.view(spark, sf, "reads").select("read_id", F.explode(reads.supplementary(F.col("sa"))).alias("s")).select("read_id", "s.chrom", "s.pos", "s.strand", "s.cigar")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return reads.usable(reads.in_windows(aligned(spark, sf), adapters.view(spark, sf, "windows")), 20)


@query
def split_read_clusters(spark, sf):
    return reads.split_clusters(_near(spark, sf)).withColumn("weight", F.round("weight", 6))


@query
def discordant_clusters(spark, sf):
    return reads.discordant_clusters(_near(spark, sf)).withColumn("weight", F.round("weight", 6))


@query
def read_scan(spark, sf):
    return reads.scanned(aligned(spark, sf), adapters.view(spark, sf, "windows"))


@query
def reads_to_calls(spark, sf):
    """Calls of windows and of artefact stretches together, as they go into the merge."""
    r, w = aligned(spark, sf), adapters.view(spark, sf, "windows")
    out = reads.as_calls(reads.scanned(r, w), reads.artefact_clusters(r, w, least=2))
    return out.select("call_seq", "record_id", "sample", "caller", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", "split_reads", "discordant_pairs", "soft_clips", "mapq", "precise")


@query
def artefact_sa_clusters(spark, sf):
    return reads.artefact_clusters(aligned(spark, sf), adapters.view(spark, sf, "windows"), least=2).drop("mapq")


@query
def library_stats(spark, sf):
    out = reads.library_stats(aligned(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query
def vcf_records(spark, sf):
    return vcf_out.records(final(spark, sf)).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "format", "sample_value")


@query
def vcf_info(spark, sf):
    return vcf_out.records(final(spark, sf)).select("id", "info")


@query
def bnd_alt_parse(spark, sf):
    out = vcf_out.records(final(spark, sf)).withColumn("b", vcf.bnd(F.col("alt")))
    return out.select("id", F.col("b.chrom").alias("mate_chrom"), F.col("b.pos").alias("mate_pos"), F.col("b.strand_a").alias("strand_a"), F.col("b.strand_b").alias("strand_b"))


@query
def info_format_maps(spark, sf):
    out = vcf_out.records(final(spark, sf))
    m, f = vcf.info_map(F.col("info")), vcf.format_map(F.col("format"), F.col("sample_value"))
    return out.select("id", vcf.to_int(m["FF_SR"]).alias("sr"), m["FF_TIER"].alias("tier"), m["IMPRECISE"].alias("imprecise"), f["PE"].alias("pe"), vcf.element(f["AD"], 2).alias("alt_depth"))


def _caller(name: str):
    def run(spark, sf):
        lines = written(callers.lines_from_calls(calls(spark, sf), name), "lines")  # as they are outside: texts in files
        return callers.summary(callers.parsed(lines, name))

    run.__name__ = f"caller_{name}"
    return query(run)


for _name in callers.CALLERS:
    _caller(_name)


@query
def vcf_scan_filter(spark, sf):
    return callers.fields(callers.lines_from_calls(calls(spark, sf), "manta")).select("line_no", F.col("f")[0].alias("chrom"), F.size("f").cast("long").alias("n_fields"))


@query
def mate_dedupe(spark, sf):
    return callers.parsed(callers.lines_from_calls(calls(spark, sf), "manta"), "manta").select("record_id", "line_no")


@query
def tsv_roundtrip(spark, sf):
    return vcf_out.from_tsv(vcf_out.to_tsv(final_with_members(spark, sf))).select("fusion_id", "tier", "n_callers", "vaf", "known_partner", "in_frame", joined("qc_flags"), joined("callers_supporting"))


@query
def json_dump(spark, sf):
    text = vcf_out.to_json(final_with_members(spark, sf))
    return text.select(F.get_json_object("value", "$.fusion_id").alias("fusion_id"), F.get_json_object("value", "$.tier").alias("tier"), F.get_json_object("value", "$.split_reads").cast("long").alias("split_reads"))
