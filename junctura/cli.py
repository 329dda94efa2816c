"""Command line: parse, call, merge, annotate, qc, emit-vcf, report, benchmark, run."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, qc, reads, reports, truth
from .plans import pipeline
from .sinks import vcf_out
from .sources import cache, callers, tables
from .sources.steps import scope, written


#: Rows of a dimension table, in bits of their place.
ORD_BITS = 40


def _calls(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    by_caller = {}
    for name in callers.CALLERS:
        if paths := getattr(args, name):
            by_caller[name] = callers.read_lines(spark, paths).withColumn("sample", F.lit(args.sample))
    return callers.parsed_all(by_caller)


def _added(spark: SparkSession, read, paths: list[str]) -> DataFrame:
    """Tables one after the other: rows of later ones come after all rows of those before."""
    parts = [read(spark, p).withColumn("ord", F.col("ord") + (k << ORD_BITS)) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def _dimensions(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _added(spark, tables.loci, [args.loci, *args.extra_loci]), _added(spark, tables.partners, [args.partners, *args.extra_partners]), tables.artefacts(spark, args.artefacts)


def _put(args: argparse.Namespace, calls: DataFrame) -> None:
    """The table of calls, and the JSON beside it."""
    calls = written(calls, "result") if args.json else calls
    vcf_out.write_tsv(calls, args.out)
    if args.json:
        vcf_out.write_json(calls, args.json, array=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="junctura", allow_abbrev=False)
    verbs = top.add_subparsers(dest="verb", required=True)
    files = argparse.ArgumentParser(add_help=False)
    for name in callers.CALLERS:
        files.add_argument(f"--{name}", nargs="*", default=[])
    files.add_argument("--sample", default="SAMPLE")
    dims = argparse.ArgumentParser(add_help=False)
    for name in ("loci", "partners", "artefacts"):
        dims.add_argument(f"--{name}", required=True)
    more = argparse.ArgumentParser(add_help=False)
    for name in ("loci", "partners"):
        more.add_argument(f"--extra-{name}", nargs="*", default=[], help="tables that are added to the first")
    result = argparse.ArgumentParser(add_help=False)
    result.add_argument("--json", help="a folder for the calls as one JSON array, in parts")
    out = argparse.ArgumentParser(add_help=False)
    out.add_argument("--out", required=True)
    table = argparse.ArgumentParser(add_help=False)
    table.add_argument("--calls", nargs="+", required=True)
    verbs.add_parser("parse", parents=[files, out], allow_abbrev=False)
    for verb in ("merge", "run"):
        p = verbs.add_parser(verb, parents=[files, out, result] + [dims, more] * (verb == "run"), allow_abbrev=False)
        p.add_argument("--eps", type=int, default=pipeline.EPS)
        p.add_argument("--algorithm", choices=sorted(pipeline.ALGORITHMS), default="dbscan", help="connected components, or greedily in input order")
    for verb in ("annotate", "qc"):
        verbs.add_parser(verb, parents=[table, dims, more, out, result], allow_abbrev=False)
    p = verbs.add_parser("emit-vcf", parents=[table, out], allow_abbrev=False)
    p.add_argument("--sample", default="SAMPLE")
    p.add_argument("--no-mates", action="store_true", help="one record for a breakend")
    p.add_argument("--one-file", action="store_true", help="--out is a file (.gz: compressed), not a folder of parts")
    p = verbs.add_parser("report", parents=[table, out], allow_abbrev=False, help="the tables that a report shows, each in a folder of its own (JSON, one object a line)")
    p.add_argument("--loci", required=True)
    p = verbs.add_parser("benchmark", parents=[table], allow_abbrev=False)
    p.add_argument("--truth", required=True)
    p.add_argument("--junctions")
    p.add_argument("--accept", nargs="+", default=["T1", "T2"], help="tiers of calls that may be true positives")
    p.add_argument("--fp-tiers", nargs="+", help="tiers of calls that may be false positives (as --accept)")
    p.add_argument("--include-unscanned", action="store_true", help="samples of the truth set without calls count")
    p.add_argument("--relax", action="store_true", help="receptor loci stand for each other")
    p.add_argument("--driver-only", action="store_true", help="with --relax: a call of the driver alone counts")
    p.add_argument("--ignore-hedges", action="store_true", help="calls with a doubtful receptor partner aren't false positives")
    p.add_argument("--out", help="a table of samples, tab-separated")
    p = verbs.add_parser("call", parents=[files, more, out, result], allow_abbrev=False, help="calls from reads: raw ones, or with --partners and --artefacts final ones, merged with callers' files")
    p.add_argument("--reads", nargs="+", required=True, help="tables of aligned reads (Parquet)")
    p.add_argument("--loci", required=True, help="windows that are scanned")
    p.add_argument("--partners")
    p.add_argument("--artefacts")
    p.add_argument("--pad", type=int, default=0)
    p.add_argument("--min-mapq", type=int, default=20)
    p.add_argument("--min-reads", type=float, default=3.0, help="weight of split reads, or of pairs, that makes a call")
    p.add_argument("--eps", type=int, default=pipeline.EPS)
    p.add_argument("--algorithm", choices=sorted(pipeline.ALGORITHMS), default="dbscan")
    p.add_argument("--no-adaptive-insert", action="store_true", help="pairs are far apart from 10 kb on, whatever the library's insert sizes")
    p.add_argument("--stats", help="folder in which the library's figures are kept for the next run over the same reads")
    return top


def _distance(spark: SparkSession, args: argparse.Namespace, rows: DataFrame) -> int:
    """From which distance on a pair is discordant: by the library's insert sizes, kept if a folder is named."""
    if args.no_adaptive_insert:
        return 10_000
    make = lambda: reads.library_stats(rows)
    stats = cache.cached(spark, args.stats, args.reads, {"of": "library_stats"}, make) if args.stats else make()
    return stats.first()["discordant_distance"]


def _call(spark: SparkSession, args: argparse.Namespace) -> int:
    """Calls of reads, of windows and artefact stretches; with the dimension tables these and the callers' calls are
    merged, annotated and checked, and counted on standard output."""
    rows, whole = spark.read.parquet(*args.reads), bool(args.partners and args.artefacts)
    artefacts = tables.artefacts(spark, args.artefacts) if args.artefacts else None
    loci = _added(spark, tables.loci, [args.loci, *args.extra_loci])
    calls = reads.calls_of_reads(rows, loci, artefacts, args.pad, _distance(spark, args, rows), args.min_mapq, args.min_reads)
    if not whole:
        calls.write.option("header", True).csv(args.out, sep="\t")
        return 0
    by_caller = any(getattr(args, n) for n in callers.CALLERS)
    calls = pipeline.together(calls, _calls(spark, args)) if by_caller else calls
    calls = written(calls, "raw-calls")
    done = pipeline.final(calls, *_dimensions(spark, args), eps=args.eps, algorithm=args.algorithm)
    _put(args, done)
    counts = tables.fusion_calls(spark, args.out).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("known_partner").alias("known")).collect()
    from_callers = {r["caller"]: r["n"] for r in calls.groupBy("caller").agg(F.count("*").alias("n")).collect()}
    print(json.dumps({"n_breakpoint_calls": from_callers, "n_candidates": sum(r["n"] for r in counts), "tier": {r["tier"]: r["n"] for r in counts}, "known_partner_count": sum(r["known"] for r in counts)}))
    return 0


def main(argv: list[str] | None = None) -> int:
    """0 if it went well, 1 on empty input, 2 on missing files or wrong arguments. Steps that were written between are
    removed at the end."""
    args = parser().parse_args(argv)
    given = [p for n in (*callers.CALLERS, "calls", "reads") for p in getattr(args, n, None) or []]
    given += [p for n in ("loci", "partners", "artefacts", "truth", "junctions") if (p := getattr(args, n, None))]
    given += [p for n in ("extra_loci", "extra_partners") for p in getattr(args, n, [])]
    if missing := tables.require(*given):
        print(f"missing: {', '.join(missing)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("junctura").getOrCreate()
    with scope(spark):
        return _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.verb in ("parse", "merge", "run"):
        if not any(getattr(args, n) for n in callers.CALLERS):
            return 1
        calls = _calls(spark, args)
        if args.verb == "parse":
            calls.write.option("header", True).csv(args.out, sep="\t")
            return 0
        done = (
            pipeline.called(calls, args.eps, algorithm=args.algorithm) if args.verb == "merge" else pipeline.final(calls, *_dimensions(spark, args), eps=args.eps, algorithm=args.algorithm)
        )
        _put(args, done)
        return 0
    if args.verb == "call":
        return _call(spark, args)
    calls = tables.fusion_calls(spark, args.calls).withColumn("cluster_id", F.monotonically_increasing_id())
    if calls.isEmpty():
        return 1
    if args.verb == "emit-vcf":
        (vcf_out.write_one_vcf if args.one_file else vcf_out.write_vcf)(calls, args.out, args.sample, mates=not args.no_mates)
    elif args.verb == "report":
        for name, df in reports.all_tables(written(calls, "report-calls"), tables.loci(spark, args.loci)).items():
            df.write.json(f"{args.out}/{name}")
    elif args.verb == "benchmark":
        seen = tables.junction_support(spark, args.junctions) if args.junctions else None
        scored = truth.scored(
            calls, tables.truth(spark, args.truth), seen, accept=tuple(args.accept), fp=tuple(args.fp_tiers) if args.fp_tiers else None, relax=args.relax or args.driver_only,
            driver_only=args.driver_only, hedges_count=not args.ignore_hedges, scanned_only=not args.include_unscanned,
        )
        if args.out:
            truth.table(scored).coalesce(1).write.option("header", True).csv(args.out, sep="\t")  # a row for each sample
        print(json.dumps(truth.summary(scored).first().asDict()))
    else:
        loci, partners, artefacts = _dimensions(spark, args)
        calls = annotate.annotated(calls, loci, partners)
        _put(args, qc.checked(calls, artefacts, qc.RECEPTOR_LOCI) if args.verb == "qc" else calls)
    return 0


if __name__ == "__main__":
    sys.exit(main())
