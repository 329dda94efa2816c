"""Several samples and files, regions, confidence intervals, reads as calls, score tables, headers."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from junctura import cli
from junctura.operators import annotate, cluster, reads, truth
from junctura.plans import pipeline
from junctura.sinks import vcf_out
from junctura.sources import callers, tables
from junctura.streaming import ingest


def vcf_of(pos: int, chrom: str = "3", info: str = "") -> str:
    return f"##x\n#CHROM\nchr{chrom}\t{pos}\tm1\tN\tN[chr9:{pos + 5}[\t9\tPASS\tSVTYPE=BND{info}\tGT:PR:SR\t0/1:9,8:9,7\n"


def test_samples_and_files_stay_apart(spark, tmp_path):
    rows = [("A", 0, vcf_of(1000).split("\n")[2]), ("B", 0, vcf_of(77000).split("\n")[2])]
    lines = spark.createDataFrame(rows, "sample string, line_no long, line string")
    got = pipeline.called(callers.parsed_all({"manta": lines, "tiddit": lines})).collect()
    assert sorted((r["sample"], r["pos_a"], r["n_callers"], r["n_members"]) for r in got) == [("A", 1000, 2, 2), ("B", 77000, 2, 2)]
    for k, pos in ((1, 1000), (2, 50_000)):
        (tmp_path / f"f{k}.vcf").write_text(vcf_of(pos))
    read = callers.read_lines(spark, [str(tmp_path / "f1.vcf"), str(tmp_path / "f2.vcf")]).withColumn("sample", F.lit("S"))
    calls = callers.parsed_all({"manta": read, "gridss": read})
    assert calls.select("call_seq").distinct().count() == calls.count() == 4
    assert sorted(r["pos_a"] for r in pipeline.called(calls).collect()) == [1000, 50_000]


def test_streamed_samples_of_one_batch_stay_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, pos in (("S1", 1000), ("S2", 90_000)):
        (tmp_path / "in" / f"{name}.vcf").write_text(vcf_of(pos))
    for name, head in (("loci", "gene\tchrom\tstart\tend\tstrand\trole\tnotes"), ("partners", "partner_a\tpartner_b\tcytoband\tdisease\tsource\tnotes"), ("artefacts", "chrom\tstart\tend\tnotes")):
        (tmp_path / f"{name}.tsv").write_text(head + "\n")
    dims = [getattr(tables, n)(spark, str(tmp_path / f"{n}.tsv")) for n in ("loci", "partners", "artefacts")]
    ingest.stream(spark, str(tmp_path / "in"), "manta", *dims, str(tmp_path / "calls"), str(tmp_path / "state")).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "calls")).collect()
    assert sorted((r["sample"], r["pos_a"]) for r in got) == [("S1", 1000), ("S2", 90_000)]


def test_lines_are_numbered_in_the_order_of_the_file(spark, tmp_path):
    text = "".join(f"line {k}\r\n" for k in range(5000))
    (tmp_path / "a.txt").write_text(text, newline="")
    (tmp_path / "b.txt").write_text("x\n\ny")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = callers.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    a = sorted((r["line_no"], r["line"].strip()) for r in got if r["file"].endswith("a.txt"))
    assert a == [(k, f"line {k}") for k in range(5000)]
    assert sorted((r["line_no"], r["line"]) for r in got if r["file"].endswith("b.txt")) == [(0, "x"), (1, ""), (2, "y")]


def test_confidence_intervals(spark):
    def ci(caller, info):
        line = vcf_of(10, info=info).split("\n")[2]
        row = callers.parsed(spark.createDataFrame([("S", 0, line)], "sample string, line_no long, line string"), caller).first()
        return [row[f"cipos_{s}_{e}"] for s in "ab" for e in ("lo", "hi")]

    assert ci("manta", ";CIPOS=-3,4") == [-3, 4, -3, 4] and ci("manta", ";CIPOS=-3,4;CIEND=0,9") == [-3, 4, 0, 9]
    assert ci("gridss", ";CIPOS=-1,1;CIRPOS=-2,2") == [-1, 1, -2, 2]
    assert ci("delly", ";CIPOS=1,2") == [1, 2, 0, 0] and ci("manta", ";CIPOS=1,2,3") == ci("svaba", ";CIPOS=1,2") == [0] * 4


def test_regions_and_the_first_of_loci_that_overlap(spark):
    loci = spark.createDataFrame([("late", "1", 105_000, 120_000, "driver", 0), ("early", "1", 100_000, 108_000, "driver", 1), ("inside", "1", 101_000, 102_000, "IG_locus", 2), ("same", "1", 100_000, 250_000, "x", 3)], "gene string, chrom string, start long, stop long, role string, ord long")
    places = [94_999, 95_000, 100_000, 108_001, 113_000, 113_001, 250_001, 255_000, 255_001]
    calls = spark.createDataFrame([(k, "chr1", p, "2", 5) for k, p in enumerate(places)], "cluster_id long, chrom_a string, pos_a long, chrom_b string, pos_b long")
    none = spark.createDataFrame([], "partner_a string, partner_b string, source string, disease string, ord long")
    got = [(r["gene_a"], r["region_a"]) for r in annotate.annotated(calls, loci, none).orderBy("cluster_id").collect()]
    early, same = "early", "same"
    assert got == [
        ("", "intergenic"), (early, "upstream"), (early, "exonic_or_intronic"), (early, "downstream"), (early, "downstream"), (same, "exonic_or_intronic"), (same, "downstream"), (same, "downstream"),
        ("", "intergenic"),
    ]
    rng = np.random.default_rng(3)
    rows = [(f"g{k}", str(k % 2), int(a), int(a + n), "driver", k) for k, (a, n) in enumerate(zip(rng.integers(0, 400_000, 60), rng.integers(0, 90_000, 60)))]
    points = [(k, str(k % 2), int(p), "9", 1) for k, p in enumerate(rng.integers(0, 500_000, 300))]
    got = {r["cluster_id"]: r["gene_a"] for r in annotate.annotated(spark.createDataFrame(points, calls.schema), spark.createDataFrame(rows, loci.schema), none).collect()}
    for k, chrom, p, *_ in points:
        held = sorted((r[2], r[5], r[0]) for r in rows if r[1] == chrom and r[2] - 5000 <= p <= r[3] + 5000)
        assert got[k] == (held[0][2] if held else "")


def test_grid_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "S", str(c), "2", "+", "-", int(a), int(b)) for k, (c, a, b) in enumerate(zip(rng.integers(1, 3, 120), rng.integers(0, 3000, 120), rng.integers(0, 3000, 120)))]
    df = spark.createDataFrame(rows, "call_seq long, sample string, chrom_a string, chrom_b string, strand_a string, strand_b string, pos_a long, pos_b long")
    owner = {}
    for r in rows:
        if r[0] not in owner:
            for x in rows:
                if x[0] not in owner and x[2] == r[2] and abs(x[6] - r[6]) <= 250 and abs(x[7] - r[7]) <= 250:
                    owner[x[0]] = r[0]
    assert {r["call_seq"]: r["cluster_id"] for r in cluster.grid_clustered(df).collect()} == owner


def test_reads_of_windows_over_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(k, str(k % 2), int(a), int(a + n)) for k, (a, n) in enumerate(zip(rng.integers(0, 90_000, 200), rng.integers(1, 25_000, 200)))]
    windows = [("w1", "0", 5_000, 41_000), ("w2", "0", 40_000, 40_001), ("w3", "1", 0, 90_000)]
    got = reads.in_windows(spark.createDataFrame(rows, "read_id long, contig string, ref_start long, ref_end long"), spark.createDataFrame(windows, "gene string, chrom string, start long, stop long"))
    want = sorted((g, k) for g, c, a, b in windows for k, x, s, e in rows if x == c and s < b and e > a)
    assert sorted((r["gene"], r["read_id"]) for r in got.collect()) == want


def test_reads_become_calls(spark, tmp_path):
    flag = 1
    rows = [(k, "S", "1", 1000, 1100, 60, flag, "70M30S", "ACGTT" * 20, 0, "1", 1200, "5,70000,+,60S40M,60,1;") for k in range(6)]
    rows += [(10 + k, "S", "1", 1000, 1100, 60, flag, "100M", "ACGTT" * 20, 0, "7", 9000, "") for k in range(5)]
    df = spark.createDataFrame(rows, "read_id long, sample string, contig string, ref_start long, ref_end long, mapq int, flag int, cigar string, seq string, tlen long, mate_contig string, mate_start long, sa string")
    df.write.parquet(str(tmp_path / "reads"))
    (tmp_path / "loci.tsv").write_text("gene\tchrom\tstart\tend\tstrand\trole\tnotes\nW\t1\t500\t2000\t+\tdriver\t\n")
    assert cli.main(["call", "--reads", str(tmp_path / "reads"), "--loci", str(tmp_path / "loci.tsv"), "--out", str(tmp_path / "out")]) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "out"), sep="\t").collect()
    assert sorted((r["caller"], r["chrom_a"], r["chrom_b"], r["pos_b"], r["split_reads"], r["discordant_pairs"]) for r in got) == [("reads", "1", "5", "70000", "6", "0"), ("reads", "1", "7", "9000", "0", "5")]
    assert len({r["record_id"] for r in got}) == 2


def test_score_table(spark, tmp_path, capsys):
    kind = "sample_id string, truth_class string, gene_a string, gene_b string"
    known = spark.createDataFrame([("S1", "confirmed", "BCL2", "IGH"), ("S2", "confirmed", "MYC", "IGH"), ("S2", "confirmed", "A", "B")], kind)
    calls = spark.createDataFrame([("S1", "T1", "IGH", "BCL2", []), ("S2", "T1", "A", "B", []), ("S2", "T2", "X", "Y", [])], "sample string, tier string, gene_a string, gene_b string, qc_flags array<string>")
    got = [(r["sample"], r["tp"], r["fp"], r["fn"], r["precision"]) for r in truth.table(truth.scored(calls, known)).collect()]
    assert got == [("S1", 1, 0, 0, 1.0), ("S2", 1, 1, 1, 0.5), ("ALL", 2, 1, 1, 2 / 3)]
    vcf_out.write_tsv(calls, str(tmp_path / "calls"))
    (tmp_path / "truth.tsv").write_text("sample_id\tcell_line\tcohort\ttruth_class\tgene_a\tgene_b\tcytoband\tsource\tnotes\nS1\t\t\tconfirmed\tIGH\tBCL2\t\t\t\nS2\t\t\tconfirmed\tA\tB\t\t\t\n")
    assert cli.main(["benchmark", "--calls", str(tmp_path / "calls"), "--truth", str(tmp_path / "truth.tsv"), "--fp-tiers", "T1", "--out", str(tmp_path / "table")]) == 0
    score = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (score["tp"], score["fp"]) == (2, 0)
    assert [r["sample"] for r in spark.read.option("header", True).csv(str(tmp_path / "table"), sep="\t").collect()] == ["S1", "S2", "ALL"]


def test_header_names_every_key_that_records_use(spark):
    lines = vcf_out.header("S", ["chr1"])
    named = {x.split("ID=")[1].split(",")[0] for x in lines if x.startswith("##INFO")}
    calls = spark.createDataFrame([("S", "f", "T1", "BND", "1", "2", 5, 6, "+", "-", "a", "b", 0.5, True, True, ["m"], ["q"], True)], "sample string, fusion_id string, tier string, sv_type string, chrom_a string, chrom_b string, pos_a long, pos_b long, strand_a string, strand_b string, gene_a string, gene_b string, vaf double, known_partner boolean, precise boolean, callers_supporting array<string>, qc_flags array<string>, in_frame boolean")
    used = {p.split("=")[0] for r in vcf_out.records(calls).collect() for p in r["info"].split(";")}
    assert used <= named and lines[-1].endswith("\tS") and any(x.startswith("##ALT=<ID=DEL") for x in lines)
