"""Scoring of calls against a truth set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qc import RECEPTOR_LOCI
from .reports import count_if

POSITIVE = ("confirmed", "likely", "driver_focal")


def pair(a: Column, b: Column) -> Column:
    """The genes of a pair that are named, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), lambda g: ~g.isin("", "-"))))


def ratios(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 from tp, fp, fn; 0 where a denominator is."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    df = df.withColumn("precision", p).withColumn("recall", r)
    return df.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def _parts(column: str, receptors: tuple[str, ...] | None) -> tuple[Column, Column]:
    """(genes that aren't receptor loci, genes that are). None: genes whose name begins with G are."""
    is_ig = (lambda g: g.isin(*receptors)) if receptors is not None else (lambda g: g.startswith("G"))
    return F.filter(F.col(column), lambda g: ~is_ig(g)), F.filter(F.col(column), is_ig)


def matches(call: str, expected: str, relax: bool, driver_only: bool, receptors: tuple[str, ...] | None) -> Column:
    same = F.col(call) == F.col(expected)
    if not relax:
        return same
    (c_drv, c_ig), (e_drv, e_ig) = _parts(call, receptors), _parts(expected, receptors)
    out = same | ((F.size(c_drv) > 0) & (c_drv == e_drv) & (F.size(c_ig) > 0) & (F.size(e_ig) > 0))
    if driver_only:
        out = out | ((F.size(e_drv) > 0) & (c_drv == e_drv) & (F.size(c_ig) == 0) & (F.size(F.col(call)) == 1))
    return out


def scored(
    calls: DataFrame, truth: DataFrame, junctions: DataFrame | None = None, accept: tuple[str, ...] = ("T1", "T2"), fp: tuple[str, ...] | None = None,
    scanned_only: bool = True, relax: bool = False, driver_only: bool = False, hedges_count: bool = True, receptors: tuple[str, ...] | None = RECEPTOR_LOCI,
) -> DataFrame:
    """sample, negative_control, tp, fn, fp, t1_calls, tp_detected, tp_lookup, disputed_rows, exempt.

    True positives are counted by expected pair (at the best tier of the calls that match), false ones by
    call. Calls that match a disputed pair are counted apart. Samples without a positive or negative row
    aren't scored.
    """
    truth = truth.select("sample_id", "truth_class", pair(F.col("gene_a"), F.col("gene_b")).alias("expected")).withColumnRenamed("sample_id", "sample")
    calls = calls.select("sample", "tier", pair(F.col("gene_a"), F.col("gene_b")).alias("found"), F.array_contains("qc_flags", "ig_partner_ambiguous").alias("hedge"))
    if scanned_only:
        truth = truth.join(calls.select("sample").distinct(), "sample", "left_semi")
    disputed, negative = F.col("truth_class") == "disputed", F.col("truth_class") == "none_expected"
    positive = F.col("truth_class").isin(*POSITIVE) & (F.size("expected") > 0)
    samples = truth.groupBy("sample").agg(
        count_if(disputed).alias("disputed_rows"), F.bool_or(positive | negative).alias("usable"), F.bool_and(negative | disputed).alias("negative_control")
    ).filter("usable").drop("usable")
    truth = truth.join(samples.select("sample"), "sample", "left_semi").withColumn("positive", positive)
    # A call's pair counts once with each sample, whatever the number of calls that share it.
    found = calls.filter(F.size("found") > 0).groupBy("sample", "found", "tier", "hedge").agg(F.count("*").alias("times"))
    match = matches("found", "expected", relax, driver_only, receptors)
    on = ["sample"]
    expected = truth.filter("positive").groupBy("sample", "expected").agg(F.count("*").alias("rows"))
    left, right = expected, found.filter(F.col("tier").isin(*accept)).groupBy("sample", "found").agg(F.min("tier").alias("tier"))
    hits = left.join(right, (left["sample"] == right["sample"]) & match, "left").groupBy(left["sample"], "expected", "rows").agg(F.min("tier").alias("best"))
    if junctions is not None:
        seen = junctions.select("sample", pair(F.col("gene_a"), F.col("gene_b")).alias("expected")).distinct().withColumn("junction", F.lit(True))
        hits = hits.join(seen, ["sample", "expected"], "left")
    else:
        hits = hits.withColumn("junction", F.lit(None).cast("boolean"))
    is_hit, rows = F.col("best").isNotNull(), F.col("rows")
    total = lambda c: F.coalesce(F.sum(F.when(c, rows)), F.lit(0)).cast("long")
    split = F.lit(junctions is not None)
    good = hits.groupBy("sample").agg(
        total(is_hit).alias("tp"), total(~is_hit).alias("fn"), total(is_hit & split & F.coalesce("junction", F.lit(False))).alias("tp_detected"),
        total(is_hit & split & ~F.coalesce("junction", F.lit(False))).alias("tp_lookup"),
    )
    wrong = found.filter(F.col("tier").isin(*(fp or accept)))
    wrong = wrong if hedges_count else wrong.filter(~F.col("hedge"))
    wrong = wrong.groupBy("sample", "found").agg(F.sum("times").alias("times")).join(samples.select("sample"), on, "left_semi")
    other = truth.filter("positive").select(F.col("sample").alias("s2"), "expected").distinct()
    wrong = wrong.join(other, (F.col("sample") == F.col("s2")) & match, "left_anti")
    doubtful = truth.filter(disputed & (F.size("expected") > 0)).select(F.col("sample").alias("s3"), "expected").distinct()
    exempt = wrong.join(doubtful, (F.col("sample") == F.col("s3")) & match, "left_semi").groupBy("sample").agg(F.sum("times").alias("exempt"))
    charged = wrong.join(doubtful, (F.col("sample") == F.col("s3")) & match, "left_anti").groupBy("sample").agg(F.sum("times").alias("fp"))
    first = calls.filter("tier = 'T1'").groupBy("sample").agg(F.count("*").alias("t1_calls"))
    out = samples
    for part in (good, charged, exempt, first):
        out = out.join(part, "sample", "left")
    zero = ["tp", "fn", "fp", "t1_calls", "tp_detected", "tp_lookup", "exempt"]
    return out.select("sample", "negative_control", "disputed_rows", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])


def summary(per_sample: DataFrame) -> DataFrame:
    sums = ["tp", "fn", "fp", "tp_detected", "tp_lookup", "disputed_rows", "exempt"]
    return ratios(per_sample.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums]))


def table(per_sample: DataFrame) -> DataFrame:
    """A row for each sample, by name, and one for all (sample ``ALL``), with ratios."""
    every = summary(per_sample).withColumn("sample", F.lit("ALL")).withColumn("negative_control", F.lit(None).cast("boolean"))
    own = ratios(per_sample)
    names = ["sample", "negative_control", "tp", "fp", "fn", "tp_detected", "tp_lookup", "disputed_rows", "exempt", "precision", "recall", "f1"]
    rows = own.select(F.lit(0).alias("last"), *names).union(every.select(F.lit(1).alias("last"), *names))
    return rows.orderBy("last", "sample").drop("last")
