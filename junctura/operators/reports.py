"""Aggregates over final calls: cohort, caller, locus and translocation summaries, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.steps import numbered

SOMATIC = ("IG_driver_canonical", "driver_driver")
REVIEW = ("IG_driver_novel", "driver_intergenic")
RECOMBINED = ("IG_intra", "IG_IG")
PHYSIOLOGICAL = ("IG_intra", "IG_IG", "driver_intra")
#: Lineage by cohort label.
B_CELL, T_CELL = ("PMBL", "DLBCL", "FL"), ("ATLL", "PTCL", "T-CELL NHL")


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")


def _top() -> Column:
    return F.col("tier").isin("T1", "T2")


def _counts() -> dict[str, Column]:
    return {
        "t1": count_if(F.col("tier") == "T1"), "t2": count_if(F.col("tier") == "T2"), "t3": count_if(F.col("tier") == "T3"),
        "somatic": count_if(F.col("event_class").isin(*SOMATIC) & _top()), "novel": count_if(F.col("event_class").isin(*REVIEW) & _top()),
        "physio": count_if(F.col("event_class").isin(*RECOMBINED)),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def cell_key(window: int, strands: bool = False) -> list[Column]:
    out = [F.col("chrom_a"), F.floor(F.col("pos_a") / window).alias("cell_a"), F.col("chrom_b"), F.floor(F.col("pos_b") / window).alias("cell_b")]
    return out + [F.col("strand_a"), F.col("strand_b")] * strands


def cohort_recurrence(calls: DataFrame, window: int = 1000) -> DataFrame:
    return calls.groupBy(*cell_key(window)).agg(F.countDistinct("sample").alias("n_samples")).filter("n_samples > 1")


def recurrence_top(calls: DataFrame, window: int = 1000, top: int = 50) -> DataFrame:
    """The most recurrent cells with an example (most callers, first seen) and the best tier."""
    example = F.max_by(F.struct("fusion_id", "driver_locus", "known_partner"), F.struct("n_callers", -F.col("first_seq")))
    by = calls.groupBy(*cell_key(window)).agg(
        F.countDistinct("sample").alias("n_samples"), example.alias("example"), F.min("tier").alias("best_tier"), F.min("first_seq").alias("seen")
    )
    by = by.filter("n_samples > 1").orderBy(F.desc("n_samples"), "seen").limit(top)
    return by.select("chrom_a", "cell_a", "chrom_b", "cell_b", "n_samples", "example.fusion_id", "example.driver_locus", "example.known_partner", "best_tier")


def per_sample(calls: DataFrame) -> DataFrame:
    canonical = F.when((F.col("event_class") == "IG_driver_canonical") & _top(), F.struct("first_seq", F.concat("gene_a", F.lit("-"), "gene_b", F.lit("|"), "tier").alias("s")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(canonical)), lambda x: x["s"]), "; ")
    return calls.groupBy("sample").agg(*_named(_counts()), listed.alias("canonical_partners"))


def kpis(calls: DataFrame) -> DataFrame:
    callers = calls.select(F.explode("callers_supporting").alias("c")).agg(F.countDistinct("c").alias("callers_run"))
    return calls.agg(*_named(_counts()), F.countDistinct("sample").alias("samples")).join(callers)  # one row each


def caller_tiers(calls: DataFrame) -> DataFrame:
    by = calls.select(F.explode("callers_supporting").alias("caller"), "tier").groupBy("caller").pivot("tier", ["T1", "T2", "T3"]).count()
    return by.select("caller", *[F.coalesce(t, F.lit(0)).alias(t.lower()) for t in ("T1", "T2", "T3")])


def histograms(calls: DataFrame) -> DataFrame:
    """kind, value, n: tiers, caller counts (every count up to the highest) and flags."""
    tiers = calls.groupBy(F.col("tier").alias("value")).count().select(F.lit("tier").alias("kind"), "value", F.col("count").alias("n"))
    n = calls.groupBy("n_callers").count()
    every = calls.agg(F.max("n_callers").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("n_callers"))
    n = every.join(n, "n_callers", "left").select(F.lit("n_callers").alias("kind"), F.col("n_callers").cast("string").alias("value"), F.coalesce("count", F.lit(0)).alias("n"))
    flags = calls.select(F.explode("qc_flags").alias("value")).groupBy("value").count().select(F.lit("flag").alias("kind"), "value", F.col("count").alias("n"))
    return tiers.union(n).union(flags)


def evidence_histogram(calls: DataFrame, columns: tuple[str, ...] = ("split_reads", "discordant_pairs"), bins: int = 40) -> DataFrame:
    """evidence, bin, n of the values above 0, in bins of equal width."""
    long = calls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("evidence"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*").filter("v > 0")
    span = long.groupBy("evidence").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    bin_of = F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low") + 1))
    return long.join(F.broadcast(span), "evidence").groupBy("evidence", bin_of.alias("bin")).agg(F.count("*").alias("n"))  # a row for each column name


def locus_summary(calls: DataFrame, loci: DataFrame, pad: int = 50_000) -> DataFrame:
    """Per locus the calls with an end near it, each call once, by tier; loci without calls are left out."""
    from .annotate import BIN

    ends = calls.select("cluster_id", "tier", "known_partner", F.explode(F.array(*[F.struct(F.col(f"chrom_{s}").alias("chrom"), F.col(f"pos_{s}").alias("pos")) for s in "ab"])).alias("e"))
    ends = ends.select("cluster_id", "tier", "known_partner", "e.chrom", "e.pos").withColumn("bin", F.floor(F.col("pos") / BIN))
    wide = loci.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - pad) / BIN), F.floor((F.col("stop") + pad) / BIN))))
    hits = ends.join(wide, ["chrom", "bin"]).filter((F.col("pos") >= F.col("start") - pad) & (F.col("pos") <= F.col("stop") + pad))
    hits = hits.select("gene", "cluster_id", "tier", "known_partner").distinct()
    return hits.groupBy("gene").agg(*[count_if(F.col("tier") == t).alias(t.lower()) for t in ("T1", "T2", "T3")], count_if(F.col("known_partner")).alias("known_partner"))


def physiological_top(calls: DataFrame, top: int = 15) -> DataFrame:
    name = F.when(F.col("gene_a") == F.col("gene_b"), F.concat("gene_a", F.lit(" (intra)"))).otherwise(F.concat_ws(" - ", "gene_a", "gene_b"))
    by = calls.filter(F.col("event_class").isin(*RECOMBINED)).groupBy(name.alias("locus")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "locus").limit(top)


def by_weight(*first: str) -> list[Column]:
    """Order of cards and lists: ``first``, tier, then split reads and pairs, most first, then as seen."""
    return [*map(F.col, first), F.col("tier"), F.desc(F.col("split_reads") + F.col("discordant_pairs")), F.col("first_seq")]


def in_order(calls: DataFrame) -> DataFrame:
    """``calls`` with place, from 0 in each sample: by tier, then by split reads and callers, most first."""
    keyed = calls.withColumns({"fewer_reads": -F.col("split_reads"), "fewer_callers": -F.col("n_callers")})
    return numbered(keyed, ["sample"], ["tier", "fewer_reads", "fewer_callers", "fusion_id"], "place").drop("fewer_reads", "fewer_callers")


def novel_top(calls: DataFrame, top: int = 60) -> DataFrame:
    """T1 and T2 calls of classes to be reviewed, by weight."""
    return calls.filter(F.col("event_class").isin(*REVIEW) & _top()).orderBy(*by_weight()).limit(top)


def between_receptors(calls: DataFrame, top: int = 200) -> DataFrame:
    """The first calls, as seen, that join two receptor loci or lie within a driver."""
    return calls.filter(F.col("event_class").isin(*PHYSIOLOGICAL) & (F.col("event_class") != "IG_intra")).orderBy("first_seq").limit(top)


def receptor_counts(calls: DataFrame) -> DataFrame:
    """gene, n of the calls within one receptor locus."""
    return calls.filter("event_class = 'IG_intra'").groupBy(F.when(F.col("gene_a") != "", F.col("gene_a")).otherwise(F.col("gene_b")).alias("gene")).agg(F.count("*").alias("n"))


def all_tables(calls: DataFrame, loci: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report, by name. ``calls`` are read by each: write them before. Calls from a file lack
    first_seq; they are numbered by their ids."""
    if "first_seq" not in calls.columns:
        calls = numbered(calls, [], ["sample", "fusion_id"], "first_seq")
    return {
        "calls": in_order(calls.filter("tier <> 'T3'")), "samples": per_sample(calls), "figures": kpis(calls), "callers": caller_tiers(calls), "histograms": histograms(calls),
        "evidence": evidence_histogram(calls), "loci": locus_summary(calls, loci), "novel": novel_top(calls), "recurrence": recurrence_top(calls), "physiological": physiological_top(calls),
        "between_receptors": between_receptors(calls), "within_receptors": receptor_counts(calls), "caller_overlap": caller_jaccard(calls),
    }


def best_per_pair(calls: DataFrame) -> DataFrame:
    """One call for each pair of genes, in whatever order they stand: the first by weight."""
    x, y = F.least("gene_a", "gene_b"), F.greatest("gene_a", "gene_b")
    best = F.min_by(F.struct("fusion_id", "tier"), F.struct("tier", -(F.col("split_reads") + F.col("discordant_pairs")), "first_seq"))
    return calls.groupBy(x.alias("gene_1"), y.alias("gene_2")).agg(best.alias("best")).select("gene_1", "gene_2", "best.fusion_id", "best.tier")


#: Fixed value: how far an arc's control point lies from the centre, as a share of the sum of its ends.
ARC_PULL = 0.15


def arc_points(arcs: DataFrame, radius: float = 1.0, points: int = 50) -> DataFrame:
    """``arcs`` (theta_1, theta_2, in radians) with step, theta (degrees) and r of ``points + 1`` points of the
    quadratic curve between both ends."""
    end = lambda f, k: f(F.col(f"theta_{k}")) * radius
    t = F.col("step") / points
    curve = lambda f: (1 - t) * (1 - t) * end(f, 1) + 2 * (1 - t) * t * (end(f, 1) + end(f, 2)) * ARC_PULL + t * t * end(f, 2)
    rows = arcs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("x", curve(F.cos)).withColumn("y", curve(F.sin))
    return rows.withColumn("theta", F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0))).withColumn("r", F.hypot("x", "y")).drop("x", "y")


def translocations(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """Calls with the class of their pair of genes. classes: gene_1, gene_2, class, label."""
    key = classes.select(F.least("gene_1", "gene_2").alias("x"), F.greatest("gene_1", "gene_2").alias("y"), "class", "label").dropDuplicates(["x", "y"])
    return calls.withColumn("x", F.least("gene_a", "gene_b")).withColumn("y", F.greatest("gene_a", "gene_b")).join(key, ["x", "y"]).drop("x", "y")


def best_per_sample(calls: DataFrame, by: tuple[str, ...] = ("class", "sample")) -> DataFrame:
    order = W.partitionBy(*by).orderBy("tier", F.desc(F.col("split_reads") + F.col("discordant_pairs")), "first_seq")
    return calls.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def caller_jaccard(calls: DataFrame, window: int = 500) -> DataFrame:
    """caller_1, caller_2, shared, jaccard over distinct cells; callers that share none are listed, too."""
    cells = calls.select(F.explode("callers_supporting").alias("caller"), F.xxhash64(*cell_key(window, True)).alias("h"), *cell_key(window, True)).distinct()
    sizes = cells.groupBy("caller").agg(F.count("*").alias("n"))
    sets = cells.groupBy("h", *[c for c in ("chrom_a", "cell_a", "chrom_b", "cell_b", "strand_a", "strand_b")]).agg(F.collect_set("caller").alias("callers"))  # a few callers each
    shared = sets.select(F.explode("callers").alias("caller_1"), "callers").select("caller_1", F.explode("callers").alias("caller_2")).groupBy("caller_1", "caller_2").agg(F.count("*").alias("shared"))
    one, two = sizes.select(F.col("caller").alias("caller_1"), F.col("n").alias("n1")), sizes.select(F.col("caller").alias("caller_2"), F.col("n").alias("n2"))
    grid = one.join(two, F.lit(True))  # callers by callers: a fixed handful
    out = grid.join(shared, ["caller_1", "caller_2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select("caller_1", "caller_2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


def replicate_overlap(calls: DataFrame, pairs: DataFrame, window: int = 500) -> DataFrame:
    """For each pair of samples: cells of T1 and T2 calls that both have, and that only one has."""
    cells = calls.filter(_top()).select("sample", F.concat_ws("|", *cell_key(window, True)).alias("cell")).distinct()
    side = pairs.select("sample_1", "sample_2", F.explode(F.array(F.struct(F.col("sample_1").alias("sample"), F.lit(1).alias("side")), F.struct(F.col("sample_2").alias("sample"), F.lit(2).alias("side")))).alias("s"))
    both = side.select("sample_1", "sample_2", "s.sample", "s.side").join(cells, "sample").groupBy("sample_1", "sample_2", "cell").agg(F.sum("side").alias("sides"))
    by = both.groupBy("sample_1", "sample_2").agg(count_if(F.col("sides") == 3).alias("shared"), count_if(F.col("sides") == 1).alias("only_1"), count_if(F.col("sides") == 2).alias("only_2"))
    return by.withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("only_1") + F.col("only_2")))


def precision_recall(calls: DataFrame, truth: DataFrame, top: int = 20) -> DataFrame:
    """threshold 0..top of split reads: precision of the calls that reach it, recall of the truth's cells.

    Calls are counted by their split reads first, so the sweep joins a few rows."""
    keys = ["chrom_a", "cell_a", "chrom_b", "cell_b", "strand_a", "strand_b"]
    known = truth.select(*keys).distinct()
    cells = calls.select(*cell_key(500, True), F.least("split_reads", F.lit(top)).alias("sr"))
    by = cells.join(known.withColumn("hit", F.lit(1)), keys, "left").groupBy("sr").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    total = known.agg(F.count("*").alias("total"))
    steps = calls.sparkSession.range(top + 1).select(F.col("id").alias("threshold"))
    by = steps.join(by, F.col("sr") >= F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    out = by.join(total)  # one row
    return out.select(
        "threshold", F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(1.0).alias("precision"),
        F.when(F.col("n") > 0, F.col("tp") / F.greatest("total", F.lit(1))).otherwise(0.0).alias("recall"),
    )


def lineage(cohort: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(cohort, F.lit(""))))
    return F.when(name.isin(*B_CELL), "B").when(name.isin(*T_CELL), "T").otherwise("any")


#: Contig lengths of the ring, in bases.
CONTIG_LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259, "6": 170805979, "7": 159345973, "8": 145138636, "9": 138394717,
    "10": 133797422, "11": 135086622, "12": 133275309, "13": 114364328, "14": 107043718, "15": 101991189, "16": 90338345, "17": 83257441, "18": 80373285,
    "19": 58617616, "20": 64444167, "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415,
}
RING_GAP = 0.6


def ring_sectors(lengths: DataFrame) -> DataFrame:
    """chrom, ord, length: adds start and stop angle, sectors in proportion with a gap after each."""
    every, before = W.partitionBy(), W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    usable = F.lit(360.0) - F.count("*").over(every) * RING_GAP
    width = F.col("length") / F.sum("length").over(every) * usable
    start = F.coalesce(F.sum("length").over(before), F.lit(0)) / F.sum("length").over(every) * usable + (F.col("ord") - 1) * RING_GAP
    return lengths.select("chrom", "length", start.alias("start_angle"), (start + width).alias("stop_angle"))
