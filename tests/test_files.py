"""Files in, files out: dimension tables, the command line, and ingest of files as they arrive."""

from __future__ import annotations

import json

import pytest

from junctura import cli
from junctura.sources import tables
from junctura.streaming import ingest

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT
chr14\t106000000\ta:1\tN\tN]chr18:63200000]\t30\tPASS\tSVTYPE=BND;MATEID=a:2\tGT:PR:SR\t0/1:9,12:9,15
chr18\t63200000\ta:2\tN\tN]chr14:106000000]\t30\tPASS\tSVTYPE=BND;MATEID=a:1\tGT:PR:SR\t0/1:9,12:9,15
"""


@pytest.fixture
def files(tmp_path):
    text = {
        "S1.vcf": VCF,
        "loci.tsv": "gene\tchrom\tstart\tend\tstrand\trole\tnotes\nIGH\tchr14\t105500000\t106900000\t-\tIG_locus\t\nBCL2\t18\t63100000\t63300000\t-\tdriver\t\n",
        "partners.tsv": "partner_a\tpartner_b\tcytoband\tdisease\tsource\tnotes\nBCL2\tIGH\tt(14;18)\tFL\tcanonical\n",
        "artefacts.tsv": "chrom\tstart\tend\tnotes\n2\t1\t100\tx\n",
        "truth.tsv": "sample_id\tcell_line\tcohort\ttruth_class\tgene_a\tgene_b\tcytoband\tsource\tnotes\nS1\tL\tFL\t\t IGH \tBCL2\t\t\t\n",
        "junctions.tsv": "sample\tgene_a\tgene_b\tsupported\nS1\tIGH\tBCL2\tyes\nS1\tA\tB\tno\n",
        "pairs.txt": "# replicates\nS1\tS2\nS3,S4\n",
    }
    for name, content in text.items():
        (tmp_path / name).write_text(content)
    return tmp_path


def test_tables(spark, files):
    at = lambda n: str(files / n)
    assert [(r["gene"], r["chrom"], r["start"]) for r in tables.loci(spark, at("loci.tsv")).orderBy("ord").collect()] == [("IGH", "14", 105500000), ("BCL2", "18", 63100000)]
    assert tables.partners(spark, at("partners.tsv")).first()["notes"] == ""
    assert tables.truth(spark, at("truth.tsv")).first()["truth_class"] == "confirmed"
    assert tables.truth(spark, at("missing.tsv")).count() == 0
    assert tables.junction_support(spark, at("junctions.tsv")).count() == 1
    assert sorted(map(tuple, tables.replicate_pairs(spark, at("pairs.txt")).collect())) == [("S1", "S2"), ("S3", "S4")]


def test_command_line(spark, files, capsys):
    at = lambda n: str(files / n)
    dims = ["--loci", at("loci.tsv"), "--partners", at("partners.tsv"), "--artefacts", at("artefacts.tsv")]
    assert cli.main(["run", "--manta", at("S1.vcf"), "--sample", "S1", *dims, "--out", at("out")]) == 0
    call = tables.fusion_calls(spark, at("out")).first()
    assert (call["gene_a"], call["gene_b"], call["known_partner"], call["tier"], call["event_class"]) == ("IGH", "BCL2", True, "T1", "IG_driver_canonical")
    capsys.readouterr()
    assert cli.main(["benchmark", "--calls", at("out"), "--truth", at("truth.tsv"), "--junctions", at("junctions.tsv")]) == 0
    score = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (score["tp"], score["fp"], score["fn"], score["tp_detected"]) == (1, 0, 0, 1)
    assert cli.main(["emit-vcf", "--calls", at("out"), "--out", at("vcf")]) == 0
    assert spark.read.text(at("vcf")).filter("value not like '#%'").count() == 2
    assert cli.main(["run", *dims, "--out", at("none")]) == 1
    assert cli.main(["qc", "--calls", at("missing"), *dims, "--out", at("none")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["run", "--infer-partners", *dims, "--out", at("none")])


def test_ingest(spark, files):
    (files / "in").mkdir()
    (files / "in" / "S7.vcf").write_text(VCF)
    dims = [getattr(tables, n)(spark, str(files / f"{n}.tsv")) for n in ("loci", "partners", "artefacts")]
    ingest.stream(spark, str(files / "in"), "manta", *dims, str(files / "calls"), str(files / "state")).awaitTermination(120)
    assert [(r["sample"], r["tier"]) for r in spark.read.parquet(str(files / "calls")).collect()] == [("S7", "T1")]
