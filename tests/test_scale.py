"""What must hold however calls and reads lie: tiles, numbering by ranges, caps, contig names, kept figures, the whole `call`."""

from __future__ import annotations

import json
import statistics
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura import cli
from junctura.operators import cluster, reads, tiers, tiles
from junctura.plans import catalogue, pipeline
from junctura.sinks import vcf_out
from junctura.sources import cache, callers, steps, tables

POINT = "call_seq long, sample string, chrom_a string, chrom_b string, strand_a string, strand_b string, pos_a long, pos_b long"


def scattered(n, span, seed):
    rng = np.random.default_rng(seed)
    seq = rng.permutation(n) + 7
    rows = [(int(k), "S", str(c), "2", None if c == 3 else "+", "-", int(a), int(b)) for k, c, a, b in zip(seq, rng.integers(1, 4, n), rng.integers(0, span, n), rng.integers(0, span, n))]
    return rows + [(1000 + k, *rows[k][1:]) for k in range(9)] + [(2000, "S", "1", "2", "+", "-", None, 5)]


def near(x, y, eps):
    return x[2] == y[2] and None not in (x[6], y[6]) and abs(x[6] - y[6]) <= eps and abs(x[7] - y[7]) <= eps


@pytest.mark.parametrize(("widths", "most"), [((1 << 20,), 10**6), ((128, 64), 6), ((), 1)])
def test_tiles_change_no_component(spark, monkeypatch, widths, most):
    monkeypatch.setattr(tiles, "WIDTHS", widths)
    rows = scattered(150, 420, 4)
    got = {r["call_seq"]: r["cluster_id"] for r in cluster.clustered(spark.createDataFrame(rows, POINT), eps=12, points_a_tile=most).collect()}
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for x in rows:
            for y in rows:
                if near(x, y, 12):
                    label[x[0]] = min(label[x[0]], label[y[0]])
    assert got == label


@pytest.mark.parametrize(("widths", "most"), [((1 << 20,), 10**6), ((128, 64), 6), ((), 1)])
def test_tiles_change_no_greedy_cluster(spark, monkeypatch, widths, most):
    monkeypatch.setattr(tiles, "WIDTHS", widths)
    rows = scattered(150, 300, 5)
    owner = {}
    for x in sorted(rows):
        if x[0] not in owner:
            owner[x[0]] = x[0]
            owner |= {y[0]: x[0] for y in rows if y[0] not in owner and near(x, y, 12)}
    got = cluster.grid_clustered(spark.createDataFrame(rows, POINT), 12, points_a_tile=most).collect()
    assert {r["call_seq"]: r["cluster_id"] for r in got} == owner


def test_width_follows_the_points_of_a_tile(spark):
    places = spark.createDataFrame([("k", a, b, a * 50 + b) for a in range(50) for b in range(50)], f"{tiles.KEY} string, pos_a long, pos_b long, seq long")
    assert tiles.width(places, 250) == tiles.WIDTHS[0]
    assert tiles.width(places, 250, 2000) == 1000  # even the narrowest holds all of them


def test_a_dense_place_is_labelled_without_its_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3000, (2, 150_000))  # thousands of neighbours each
    x, _ = tiles.near_links(np.zeros(len(a), int), a, b, 250)
    assert len(x) < 10 * len(a) and set(cluster._label(np.zeros(len(a), int), a, b, np.arange(len(a)), 250)) == {0}


def test_numbers_over_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(None if k % 7 == 0 else f"s{k % 3}", int(v), k) for k, v in enumerate(rng.permutation(500))]
    df = spark.createDataFrame(rows, "sample string, v long, k long").repartition(4)
    got = {r["k"]: r["place"] for r in steps.numbered(df, ["sample"], ["v"], "place").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        want |= {k: i for i, (_, k) in enumerate(sorted((v, k) for x, v, k in rows if x == s))}
    assert got == want
    got = {r["k"]: r["place"] for r in steps.numbered(df, [], ["v"], "place").collect()}
    assert got == {k: v for _, v, k in rows}


READ = "read_id long, sample string, contig string, ref_start long, ref_end long, mapq int, flag int, cigar string, seq string, tlen long, mate_contig string, mate_start long, sa string"


def some_reads(n=400, named="", seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        at = int(rng.integers(900, 2100))
        clip = k % 3 < 2
        sa = f"{named}5,{70_000 + 3 * (k % 2)},+,60S40M,60,1;" if clip else ""
        out.append((k, "S", f"{named}{1 + k % 2}", at, at + 100, int(rng.integers(0, 61)), 1, "70M30S" if clip else "100M", "ACGTT" * 20, int(rng.integers(0, 600)), f"{named}7", 9000 + k % 40, sa))
    return out


WINDOWS = [("w1", "1", 500, 2000), ("w2", "chr2", 1000, 1500), ("w3", "9", 0, 10)]


def windows(spark):
    return spark.createDataFrame(WINDOWS, "gene string, chrom string, start long, stop long")


def test_a_full_window_keeps_its_first_reads(spark):
    rows = some_reads()
    got = reads.in_windows(spark.createDataFrame(rows, READ), windows(spark), rows=60).collect()
    for gene, contig, start, stop in (("w1", "1", 500, 2000), ("w2", "2", 1000, 1500)):
        inside = sorted(r[0] for r in rows if r[2] == contig and r[3] < stop and r[4] > start)
        assert sorted(r["read_id"] for r in got if r["gene"] == gene) == inside[:60] and len(inside) > 60


def test_contigs_with_and_without_chr_are_scanned_alike(spark):
    def found(named):
        rows = spark.createDataFrame(some_reads(named=named), READ)
        return sorted(map(tuple, reads.calls_of_reads(rows, windows(spark), spark.createDataFrame([("2", 1200, 1300)], "chrom string, start long, stop long"), least=2.0).drop("call_seq").collect()))

    assert found("") == found("chr") and {r[1] for r in found("")} == {"reads", "reads_artefact"}


def test_library_figures_stop_at_the_last_insert_or_read(spark):
    for n, size in ((400, 10), (400, 20), (400, 1000), (0, 5)):
        rows = [(k, "S", "chr1" if k % 4 else "2", int(30_000_000 + a), int(30_000_000 + a + 100), int(q), int(f), "30S70M" if k % 3 else "100M", "A", int(t), "1", 1, "") for k, (a, q, f, t) in enumerate(np.random.default_rng(n + size).integers((0, 0, 0, -700), (40_000_000, 61, 3000, 700), (n, 4)))]
        got = reads.library_stats(spark.createDataFrame(rows, READ), size).first()
        seen, inserts, clips, quality, supplementary, duplicate = 0, [], [], [], 0, 0
        for r in sorted((r for r in rows if r[2] == "chr1" and r[4] > 30_000_000 and r[3] < 60_000_000), key=lambda r: (r[3], r[0])):
            seen += 1
            if seen > 4 * size:
                break
            if r[6] & 2304:
                supplementary += bool(r[6] & 2048)
                continue
            if r[6] & 4:
                continue
            if r[6] & 1024:
                duplicate += 1
                continue
            if r[5] >= 20 and 0 < abs(r[9]) < 100_000:
                inserts.append(abs(r[9]))
            clips.append(30 if r[7] == "30S70M" else 0)
            quality.append(r[5])
            if len(inserts) >= size:
                break
        assert (got["n_reads"], got["n_inserts"]) == (seen, len(inserts))
        assert abs(got["supplementary_share"] - supplementary / max(seen, 1)) < 1e-9 and abs(got["duplicate_share"] - duplicate / max(seen, 1)) < 1e-9
        if inserts:
            median = statistics.median(inserts)
            mad = statistics.median(abs(x - median) for x in inserts)
            assert (got["insert_median"], got["insert_mad"], got["mapq_median"], got["clip_median"]) == (median, mad, statistics.median(quality), statistics.median(clips))
            assert got["discordant_distance"] == int(median + 5 * mad)
        else:
            assert got["discordant_distance"] == 10_000


def test_figures_are_kept_until_the_files_change(spark, tmp_path):
    at, made = str(tmp_path / "reads"), []
    spark.createDataFrame(some_reads(40), READ).write.parquet(at)

    def make():
        made.append(1)
        return reads.library_stats(spark.read.parquet(at))

    get = lambda of=1: cache.cached(spark, str(tmp_path / "kept"), [at], {"of": of}, make).first()
    assert get() == get() and len(made) == 1
    assert get(2) == get() and len(made) == 2
    spark.createDataFrame(some_reads(10, seed=4), READ).write.mode("append").parquet(at)
    assert get()["n_reads"] > 20 and len(made) == 3
    assert not [p for p in (tmp_path / "kept").iterdir() if p.name.startswith("rough")]


VCF = "##fileformat=VCFv4.2\n" + "".join(
    f"1\t{1550 + k}\td{k}\tN\tN]5:{70_000 + k}]\t30\tPASS\tSVTYPE=BND;PE=9;SR=9\tGT:DR:DV:RR:RV\t0/1:1:9:1:9\n" for k in (0, 40, 9000)
)
DIMENSIONS = {
    "loci.tsv": "gene\tchrom\tstart\tend\tstrand\trole\tnotes\nW\t1\t500\t2000\t+\tdriver\t\nV\t2\t1000\t1500\t+\tdriver\t\n",
    "partners.tsv": "partner_a\tpartner_b\tcytoband\tdisease\tsource\tnotes\nW\tX\t\t\tcanonical\n",
    "artefacts.tsv": "chrom\tstart\tend\tnotes\n2\t1200\t1300\tx\n",
}


def test_call_goes_from_reads_and_files_to_final_calls(spark, tmp_path, capsys):
    for name, text in DIMENSIONS.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "a.vcf").write_text(VCF)
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame(some_reads(), READ).write.parquet(at("reads"))
    dims = [f"--{n}={at(n + '.tsv')}" for n in ("loci", "partners", "artefacts")]
    args = ["call", "--reads", at("reads"), *dims, "--delly", at("a.vcf"), "--sample", "S", "--stats", at("kept")]
    before = set(steps._kept)
    assert cli.main([*args, "--out", at("out")]) == 0
    assert set(steps._kept) == before  # written steps are gone
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    done = tables.fusion_calls(spark, at("out"))
    loci, partners, artefacts = (getattr(tables, n)(spark, at(f"{n}.tsv")) for n in ("loci", "partners", "artefacts"))
    rows = spark.read.parquet(at("reads"))
    distance = reads.library_stats(rows).first()["discordant_distance"]
    parts = [reads.as_calls(reads.scanned(rows, loci, distance=distance), reads.artefact_clusters(rows, reads.artefact_windows(artefacts))), callers.parsed_all({"delly": callers.read_lines(spark, [at("a.vcf")]).withColumn("sample", F.lit("S"))})]
    together = pipeline.together(*parts)
    seqs = [r["call_seq"] for r in together.select("call_seq").collect()]
    assert len(set(seqs)) == len(seqs) == sum(told["n_breakpoint_calls"].values())
    want = pipeline.final(together, loci, partners, artefacts)
    show = lambda d: sorted(map(str, d.select("sample", "fusion_id", "tier", "split_reads", "discordant_pairs", F.array_join("callers_supporting", ",")).collect()))
    assert show(done) == show(want) and told["n_candidates"] == done.count()
    assert any(r["callers_supporting"] == ["delly", "reads"] for r in done.collect())  # the two meet in one cluster
    assert cli.main([*args, "--algorithm", "bucket", "--out", at("out2")]) == 0
    with pytest.raises(SystemExit):
        cli.main([*args, "--algorithm", "other", "--out", at("out3")])


def test_call_numbers_are_the_same_again_and_unlike_those_of_files(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(k, f"S{k % 40}", *r[2:]) for k, r in enumerate(some_reads(3000))]
        found = reads.scanned(spark.createDataFrame(rows, READ).repartition(7), windows(spark), min_split=1.0, min_pairs=1.0)
        one, two = ({tuple(r) for r in reads.as_calls(found).select("call_seq", "record_id", "sample", "chrom_a", "pos_a").collect()} for _ in range(2))
        assert one == two and len({r[0] for r in one}) == len(one) > 50 and min(r[0] for r in one) >= reads.READS_SEQ
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ids_of_a_sample_that_holds_most_calls(spark):
    kind = "cluster_id long, sample string, first_seq long, chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string"
    rows = [(k, "hot" if k % 10 else "cold", k * 37 % 1009, "1", k, "+", "2", k, "-") for k in range(1000)]
    got = {r["cluster_id"]: r["fusion_id"] for r in tiers.with_ids(spark.createDataFrame(rows, kind)).collect()}
    for sample in ("hot", "cold"):
        own = sorted((r for r in rows if r[1] == sample), key=lambda r: r[2])
        assert [got[r[0]].rpartition("__")[2] for r in own] == [f"{i:05d}" for i in range(len(own))]


def test_a_self_join_of_calls_works_out_no_end_twice(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_discount double"
    spark.createDataFrame([(k, 1 + k % 7, k * 3, k % 5, 1.0, 2.0, "R", "O", 0.1) for k in range(50)], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = catalogue.QUERIES["neighbour_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan and "RLIKE" not in plan


def test_steps_are_discarded(spark):
    with steps.scope(spark):
        df = steps.written(spark.range(5), "x")
        kept = set(steps._kept)
        steps.discard(df)
        assert len(kept - set(steps._kept)) == 1
        steps.written(spark.range(5), "y")
    assert Counter(steps._kept)[next(iter(kept))] <= 1 and len(set(steps._kept) & kept) == len(kept) - 1


def test_tiers_of_either_algorithm(spark):
    kind = POINT + ", caller string, sv_type string, record_id string, split_reads long, discordant_pairs long, assembly_contigs long, soft_clips long, vaf double, raw_qual double, precise boolean, filter_pass boolean"
    rows = [(k, "S", "1", "2", "+", "-", 100 + 200 * k, 100, "m", "BND", f"r{k}", 5, 5, 0, 0, 0.1, 1.0, True, True) for k in range(3)]
    df = spark.createDataFrame(rows, kind)
    assert {a: sorted(r["n_members"] for r in pipeline.called(df, algorithm=a).collect()) for a in pipeline.ALGORITHMS} == {"dbscan": [3], "bucket": [1, 2]}
    with pytest.raises(ValueError):
        pipeline.called(df, algorithm="other")
    assert vcf_out.COLUMNS


def test_files_and_tables_of_the_command_line(spark, tmp_path):
    import gzip

    for name, text in DIMENSIONS.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "more_loci.tsv").write_text("gene\tchrom\tstart\tend\tstrand\trole\tnotes\nX\t5\t69000\t71000\t+\tdriver\t\n")
    (tmp_path / "more_partners.tsv").write_text("partner_a\tpartner_b\tcytoband\tdisease\tsource\tnotes\nX\tW\t\tZ\tadded\t\n")
    (tmp_path / "a.vcf").write_text(VCF)
    at = lambda n: str(tmp_path / n)
    dims = [f"--{n}={at(n + '.tsv')}" for n in ("loci", "partners", "artefacts")]
    run = ["run", "--delly", at("a.vcf"), "--sample", "S", *dims]
    assert cli.main([*run, "--extra-loci", at("more_loci.tsv"), "--extra-partners", at("more_partners.tsv"), "--out", at("out"), "--json", at("json")]) == 0
    calls = tables.fusion_calls(spark, at("out")).collect()
    assert {(r["gene_a"], r["gene_b"], r["known_partner_source"]) for r in calls} == {("W", "X", "canonical"), ("", "", "")}  # the first of equal pairs
    array = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    assert [x["fusion_id"] for x in array] == sorted(r["fusion_id"] for r in calls)
    vcf_out.write_json(tables.fusion_calls(spark, at("out")).limit(0), at("none"), array=True)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == []

    for name, read in (("a.vcf.gz", lambda p: gzip.open(p, "rt").read()), ("b.vcf", lambda p: open(p).read())):
        assert cli.main(["emit-vcf", "--calls", at("out"), "--out", at(name), "--one-file", "--sample", "T"]) == 0
        lines = read(at(name)).splitlines()
        head, rows = [x for x in lines if x.startswith("#")], [x.split("\t") for x in lines if not x.startswith("#")]
        assert lines[: len(head)] == head and head[-1].endswith("\tT") and [(r[0], int(r[1])) for r in rows] == sorted((r[0], int(r[1])) for r in rows) and len(rows) == 2 * len(calls)
        assert not [p for p in tmp_path.iterdir() if p.name.endswith("rough")]
    assert cli.main(["emit-vcf", "--calls", at("out"), "--out", at("c.vcf"), "--one-file", "--no-mates"]) == 0
    rows = [x.split("\t") for x in open(at("c.vcf")).read().splitlines() if not x.startswith("#")]
    assert sorted(r[2] for r in rows) == sorted(r["fusion_id"] for r in calls) and not any("MATEID" in r[7] for r in rows)

    assert cli.main(["report", "--calls", at("out"), "--loci", at("loci.tsv"), "--out", at("report")]) == 0
    assert spark.read.json(at("report/samples")).count() == 1 and spark.read.json(at("report/calls")).count() == sum(r["tier"] != "T3" for r in calls)
    assert len([p for p in (tmp_path / "report").iterdir() if p.is_dir()]) == 13


def test_batches_of_a_sample_give_what_one_batch_gives(spark, tmp_path):
    from junctura.streaming import ingest

    for name, text in DIMENSIONS.items():
        (tmp_path / name).write_text(text)
    line = lambda k, p, q: f"1\t{p}\td{k}\tN\tN]5:{q}]\t30\tPASS\tSVTYPE=BND;PE=9;SR=9\tGT:DR:DV:RR:RV\t0/1:1:9:1:9\n"
    for name, rows in {"S.1": [(1, 1550, 70_000), (2, 90_000, 5)], "S.2": [(3, 1600, 70_100)], "T.1": [(4, 1500, 70_050)]}.items():
        (tmp_path / f"{name}.vcf").write_text("##fileformat=VCFv4.2\n" + "".join(line(*r) for r in rows))
    at = lambda *names: [str(tmp_path / n) for n in names]
    dims = [getattr(tables, n)(spark, str(tmp_path / f"{n}.tsv")) for n in ("loci", "partners", "artefacts")]
    put = lambda paths, number, to: ingest.absorb(spark, paths, number, "delly", *dims, str(tmp_path / to), str(tmp_path / f"{to}-state"))
    seen = lambda to: sorted(map(str, spark.read.parquet(str(tmp_path / to)).drop("sample_key").collect()))
    put(at("S.1.vcf", "S.2.vcf", "T.1.vcf"), 0, "once")
    put(at("S.1.vcf"), 0, "twice")
    put(at("S.2.vcf", "T.1.vcf"), 1, "twice")
    assert seen("once") == seen("twice") and len(seen("once")) == 3  # the files' near calls are one
    put(at("S.2.vcf", "T.1.vcf"), 1, "twice")
    assert seen("once") == seen("twice")
    assert ingest.recurrence(spark, str(tmp_path / "twice")).count() == 1


def test_a_weight_half_way_is_rounded_to_even_in_any_order(spark):
    n, q = 45, 21  # the sum of 21 / 30 as floats stays below 31.5
    rows = [(k, "S", "1", 1000, 1100, q, 1, "70M30S", "ACGTT" * 20, 300, "1", 1200, "5,70000,+,60S40M,60,1;") for k in range(n)]
    got = reads.scanned(spark.createDataFrame(rows, READ), windows(spark)).filter("kind = 'split' and gene = 'w1'").collect()
    assert [r["split_reads"] for r in got] == [round(Fraction(n * q, 30))]


def test_artefact_windows_are_read_whole(spark):
    """More reads than a cap of 200,000, of which only the last ones give a cluster."""
    good = [(200_000 + k, "S", "1", 1000, 1100, 60, 1, "70M30S", "ACGTT" * 20, 300, "1", 1200, "5,70000,+,60S40M,60,1;") for k in range(2)]
    unmapped = spark.range(200_000).selectExpr("id", "'S'", "'1'", "1000L", "1100L", "60", "4", "'100M'", "''", "0L", "'1'", "1200L", "''").toDF(*[c.split()[0] for c in READ.split(", ")])
    got = reads.artefact_clusters(unmapped.union(spark.createDataFrame(good, READ)), windows(spark), least=2).collect()
    assert [(r["gene"], r["n"]) for r in got] == [("w1", 2)]


def test_lists_of_members_stay_with_the_clusters(spark, monkeypatch):
    """Only the step of the clusters holds the lists, and the final calls have them all the same."""
    held = {}
    keep = lambda df, name: held.setdefault(name, []).append(df.columns) or real(df, name)
    real = steps.written
    for module in (cluster, pipeline, steps):
        monkeypatch.setattr(module, "written", keep)
    row = lambda k: (k, "S", "manta", "BND", "1", 1000 + k, "+", "2", 5000 + k, "-", 5, 5, 0, 0, True, True, 0.1, 1.0, f"r{k}")
    calls = spark.createDataFrame([row(k) for k in range(3)], "call_seq long, sample string, caller string, sv_type string, chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string, split_reads long, discordant_pairs long, assembly_contigs long, soft_clips long, filter_pass boolean, precise boolean, vaf double, raw_qual double, record_id string")
    loci = spark.createDataFrame([], "gene string, chrom string, start long, stop long, role string, ord long")
    partners = spark.createDataFrame([], "partner_a string, partner_b string, source string, disease string, ord long")
    out = pipeline.final(calls, loci, partners, spark.createDataFrame([], "chrom string, start long, stop long"))
    assert [r["member_record_ids"] for r in out.collect()] == [["r0", "r1", "r2"]]
    assert {name for name, of in held.items() if any("member_record_ids" in c for c in of)} == {"clusters"}
    assert "member_record_ids" not in cluster.clusters(calls.drop("record_id").withColumn("cluster_id", F.lit(0))).columns


def test_later_greedy_rounds_read_open_tiles_only(spark, monkeypatch):
    """Of 300 places in tiles of their own, three lie in a row across a tile's edge: only their tiles have another round."""
    rows, real = [], steps.written

    def keep(df, name):
        out = real(df, name)
        rows.append(out.count() if name == "settled" else 0)
        return out

    monkeypatch.setattr(cluster, "written", keep)
    monkeypatch.setattr(tiles, "WIDTHS", (100,))
    near = [(0, 1005), (1, 995), (2, 985)]
    calls = spark.createDataFrame([(k, "S", "1", "2", "+", "+", p, 50) for k, p in [*near, *((k, 2050 + 100 * k) for k in range(3, 300))]], POINT)
    got = {r["call_seq"]: r["cluster_id"] for r in cluster.grid_clustered(calls, 12).collect()}
    assert got == {k: 0 if k < 2 else k for k in range(300)}
    assert len([n for n in rows if n]) > 1 and sum(rows) < 320


def test_calls_find_their_cluster_by_cell(spark, monkeypatch):
    """Calls of one cell are one row of what calls are joined with, and are no row of a shuffle there."""
    kept, write = {}, steps.written
    monkeypatch.setattr(cluster, "written", lambda d, name: kept.setdefault(name, write(d, name)))
    n, far = 3000, 251 * 4
    place = F.when(F.col("id") < n, F.col("id") % 251).otherwise(far + F.col("id") % 7)
    calls = spark.range(n + 50).select(
        F.col("id").alias("call_seq"), F.lit("S").alias("sample"), F.lit("1").alias("chrom_a"), F.lit("2").alias("chrom_b"), F.lit("+").alias("strand_a"), F.lit("-").alias("strand_b"),
        F.when(F.col("id") != n + 49, place).alias("pos_a"), (place + F.col("id") % 13).alias("pos_b"),
    )
    out = cluster.clustered(calls)
    got = {r["cluster_id"]: r["n"] for r in out.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n, n: 49, n + 49: 1}
    assert kept["places"].count() > 1000 and kept["cells"].count() <= 3
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiles_hold_a_row_for_each_cell(spark, monkeypatch):
    """What tiles label grows with the cells, not with the places of calls."""
    kept, write = {}, steps.written
    monkeypatch.setattr(cluster, "written", lambda d, name: kept.setdefault(name, write(d, name)))
    rows = [(k, "S", "1", "2", "+", "-", k % 499, (k * 7) % 499) for k in range(2000)]
    got = cluster.clustered(spark.createDataFrame(rows, POINT)).select("cluster_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    assert kept["places"].count() > 400 and kept["labels"].count() <= 9


@pytest.mark.parametrize("most", [10**6, 1])
def test_cells_that_touch_at_a_corner(spark, monkeypatch, most):
    """Cells (13 wide) whose boxes don't tell: both a near and a far pair, up and down, within a tile and across tiles."""
    kept, write = {}, steps.written
    monkeypatch.setattr(cluster, "written", lambda d, name: kept.setdefault(name, write(d, name)))
    rng, rows = np.random.default_rng(8), []
    for key in range(120):
        x, y = (int(v) for v in rng.integers(-3, 9, 2) * 13)
        rise = 13 if key % 2 else -13
        for k in range(2, 6):
            for a, b in ((x, y), (x + 13, y + rise)):
                rows.append((len(rows) * 31 % 4999, "S", str(key), "2", "+", "-", a + int(rng.integers(0, 13)), b + int(rng.integers(0, 13))))
            if k > 2 + key % 3:
                break
    got = {r["call_seq"]: r["cluster_id"] for r in cluster.clustered(spark.createDataFrame(rows, POINT), eps=12, points_a_tile=most).collect()}
    want = {}
    for key in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == key]
        label = {r[0]: r[0] for r in own}
        for _ in own:
            for p in own:
                for q in own:
                    if near(p, q, 12):
                        label[p[0]] = min(label[p[0]], label[q[0]])
        want |= label
    assert got == want
    doubt = kept["corners"].select("cluster_key", "tile_a", "tile_b").distinct().count()
    together = sum(len({want[r[0]] for r in rows if r[2] == str(key)}) == 1 for key in range(120))
    assert doubt > 20 and 10 < together < 110


@pytest.mark.parametrize("eps", [0, 1, 12])
def test_pairs_meet_by_cells_of_both_ends(spark, eps):
    """Calls that share one end only aren't compared; each pair comes once, wherever cells are cut; an end or a key that
    isn't known is near nothing."""
    rows = [(*r[:6], None if r[6] is None else r[6] - 60, r[7] - 60) for r in scattered(200, 40 + 12 * eps, 6)]
    rows += [(3000 + k, "S", "1", "2", "+", "-", 7, 1000 * k) for k in range(40)]
    pairs = cluster.band_edges(spark.createDataFrame(rows, POINT), eps)
    got = sorted((r["a"], r["b"]) for r in pairs.collect())
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and None not in x[:6] and near(x, y, eps))
    join = next(line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert "cell_a" in join and "cell_b" in join


def test_a_scan_reads_windows_whole(spark, monkeypatch):
    """However many reads a window holds, none is left out: the cluster is that of the last ones."""
    monkeypatch.setattr(reads, "ROWS_A_LOCUS", 20)
    monkeypatch.setattr(reads.in_windows, "__defaults__", tuple(20 if v == 5_000_000 else v for v in reads.in_windows.__defaults__))
    rows = [(k, "S", "1", 1000, 1100, 60, 1, "70M30S" if k >= 40 else "100M", "ACGTT" * 20, 300, "1", 1200, "5,70000,+,60S40M,60,1;" if k >= 40 else "") for k in range(44)]
    got = reads.scanned(spark.createDataFrame(rows, READ), windows(spark)).filter("gene = 'w1'").collect()
    assert [(r["kind"], r["split_reads"]) for r in got] == [("split", 4)]
    assert [r["split_reads"] for r in reads.calls_of_reads(spark.createDataFrame(rows, READ), windows(spark)).filter("caller = 'reads' and record_id like 'reads_w1%'").collect()] == [4]


def test_what_a_read_tells_is_worked_out_once(spark, monkeypatch):
    """Texts of reads are looked into before the step that both kinds of cluster read, and clusters hold a row for each place."""
    kept, write = {}, steps.written
    monkeypatch.setattr(reads, "written", lambda d, name: kept.setdefault(name, []).append(write(d, name)) or kept[name][-1])
    rows = [(k, "S", "1", 1000 + k % 3, 1100 + k % 3, 60, 1, "70M30S" if k % 2 else "100M", "ACGTT" * 20, 300, "7", 1200 + k % 2, "5,70000,+,60S40M,60,1;" if k % 2 else "") for k in range(40)]
    out = reads.scanned(spark.createDataFrame(rows, READ), windows(spark)).filter("gene = 'w1'")
    assert [tuple(r) for r in out.select("kind", "pos_a", "pos_b", "split_reads", "discordant_pairs").orderBy("kind").collect()] == [("pair", 1101, 1200, 0, 20), ("split", 1101, 70000, 20, 0)]
    (once,) = kept["told"]
    assert not {"seq", "cigar", "sa"} & set(once.columns) and once.filter("gene = 'w1'").count() == 40
    assert "seq#" not in out._jdf.queryExecution().optimizedPlan().toString()


def lines_at(spark, at, first, step, n=400):
    """Lines of orders from ``first`` on, and their packed numbers."""
    rng = np.random.default_rng(11)
    cols = [first + step * rng.permutation(n), 400 * rng.integers(0, 18_000, n) + rng.integers(0, 2, n), rng.integers(0, 360_000, n), rng.integers(1, 8, n), rng.integers(1, 51, n)]
    keys = [tuple(int(v) for v in r) for r in zip(*cols)]
    rows = [(*k[:4], float(k[4]), 1000.0 + k[0] % 90, 0.05, "RAN"[k[0] % 3], "OF"[k[0] % 2]) for k in keys]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{at}/lineitem.parquet")
    return sorted((((o * 8 + k) * 100003 + p) * 10007 + s) * 64 + q for o, p, s, k, q in keys)


def test_calls_of_late_orders_have_numbers_in_order(spark, tmp_path):
    """Packed numbers longer than a long: call_seq keeps their order and remainders, record_id their digits."""
    packed = lines_at(spark, tmp_path, 53_999_000, 2)
    assert packed[-1] > 1 << 63
    got = catalogue.calls(spark, str(tmp_path)).select("call_seq", "record_id").orderBy("call_seq").collect()
    assert [r["record_id"] for r in got] == [f"r{v}" for v in packed] and len(set(packed)) == len(packed)
    assert all((r["call_seq"] - v) % (11 * 13 * 61 * 400 * 63) == 0 for r, v in zip(got, packed, strict=True))


@pytest.mark.parametrize("first", [9_500_000, 17_000_000])
def test_calls_keep_their_packed_numbers_as_far_as_these_are_longs(spark, tmp_path, first):
    """Also where twice the number, which tells lines of callers' files, is no long."""
    packed = lines_at(spark, tmp_path, first, 2)
    assert 1 << 62 < packed[-1] < 1 << 63
    assert [r["call_seq"] for r in catalogue.calls(spark, str(tmp_path)).orderBy("call_seq").collect()] == packed
    calls = catalogue.calls(spark, str(tmp_path)).filter("caller = 'svaba'")
    got = [r["record_id"] for r in catalogue.QUERIES["caller_svaba"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(r["record_id"] + ":1" * (r["sv_type"] == "BND") for r in calls.collect()) and got


@pytest.mark.parametrize("name", ["caller_gridss", "caller_svaba", "neighbour_pairs", "grid_clusters"])
def test_queries_of_late_orders_are_those_of_the_sql_in_wider_numbers(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    packed = lines_at(spark, tmp_path, 53_999_000, 2)
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    if name == "grid_clusters":
        assert got.agg(F.sum("members")).first()[0] == len(packed)
        return
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(l_orderkey AS HUGEINT) AS l_orderkey) FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    told = {r["call_seq"]: r["record_id"][1:] for r in catalogue.calls(spark, str(tmp_path)).select("call_seq", "record_id").collect()}
    assert sorted(tuple(str(told[v]) if c in ("a", "b") else str(v) for c, v in zip(got.columns, r)) for r in got.collect()) == want and want
