"""Breakpoint callers' files: records of text, and what each caller's fields say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import contigs, vcf
from .steps import written

#: Lines of a file, in bits of call_seq; the bits above number the files.
LINE_BITS = 38
CALLERS = ("manta", "gridss", "delly", "svaba", "tiddit", "factera")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, line_no, line of text files (gzip by suffix). Files are read in blocks, as Spark splits them; the
    blocks' numbers of lines are counted first, so line numbers rise without gaps in the order of the file."""
    rows = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row for each block
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("line_no"), "line")


def fields(lines: DataFrame) -> DataFrame:
    """Adds f, the tab-separated fields; blank lines and those that begin with # are left out."""
    return lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split(F.regexp_replace("line", "[\r\n]+$", ""), "\t", -1))


def records(lines: DataFrame) -> DataFrame:
    """Fields of variant records by name, INFO and the first sample as maps; short records are left out."""
    g = lambda k: F.get(F.col("f"), F.lit(k))
    out = fields(lines).filter(F.size("f") >= 8)
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
    file = F.col("file") if "file" in lines.columns else F.lit("").alias("file")
    # Entries are columns of their own, as the maps look at them several times.
    out = out.select(
        "sample", file, "line_no", *[g(k).alias(n) for k, n in enumerate(names)], vcf.info_entries(g(7)).alias("info_entries"),
        vcf.format_entries(F.coalesce(g(8), F.lit("")), F.coalesce(g(9), F.lit(""))).alias("fmt_entries"),
    ).withColumns({"pos": vcf.to_int(F.col("pos")), "info": vcf.last_of_each(F.col("info_entries")), "fmt": vcf.last_of_each(F.col("fmt_entries"))})
    return out.drop("info_entries", "fmt_entries")


def _first_of_mates(rows: DataFrame, only: Column, by: Column) -> DataFrame:
    """Of the records of one event in a file (where ``only`` holds) the first in file order."""
    place = F.row_number().over(W.partitionBy("sample", "file", only, by).orderBy("line_no"))
    return rows.withColumn("mate_place", place).filter(~only | (F.col("mate_place") == 1)).drop("mate_place")


def _mates() -> Column:
    """The unordered pair of ID and MATEID; records without an ID are on their own."""
    mate = F.coalesce(F.nullif(F.col("info")["MATEID"], F.lit("")), F.col("id"))
    return F.when(F.col("id") == ".", F.concat(F.lit("\t"), F.col("line_no").cast("string"))).otherwise(F.concat_ws("\t", F.least("id", mate), F.greatest("id", mate)))


def _call(rows: DataFrame, caller: str, ends: dict[str, Column], evidence: dict[str, Column], record_id: Column, sv_type: Column) -> DataFrame:
    """ends: c1, p1, s1, c2, p2, s2, and ci1 and ci2 (confidence intervals in the order of the record, not of
    the ends) where the caller has them."""
    none = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    ends = {"ci1": none, "ci2": none} | ends
    rows = rows.select("sample", "line_no", record_id.alias("record_id"), sv_type.alias("sv_type"), *[c.alias(n) for n, c in ends.items()], *[c.alias(n) for n, c in evidence.items()])
    rows = contigs.with_ends(rows, *[F.col(n) for n in ("c1", "p1", "s1", "c2", "p2", "s2")]).withColumn("caller", F.lit(caller))
    return rows.withColumns({f"cipos_{s}_{end}": F.col(f"ci{k}.{end}") for k, s in ((1, "a"), (2, "b")) for end in ("lo", "hi")}).drop("c1", "p1", "s1", "c2", "p2", "s2", "ci1", "ci2")


def _strip(chrom: Column) -> Column:
    return contigs.strip_chr(chrom)


def _bnd_or(bnd_when: Column, other: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Ends from the ALT where it holds a breakend, else (own strand, contig, position, strand)."""
    b = F.col("b")
    strand1, chrom2, pos2, strand2 = other
    pick = lambda x, y: F.when(bnd_when, x).otherwise(y)
    return {
        "c1": _strip(F.col("chrom")), "p1": F.col("pos"), "s1": pick(b["strand_a"], strand1), "c2": _strip(pick(b["chrom"], chrom2)), "p2": pick(b["pos"], pos2), "s2": pick(b["strand_b"], strand2),
    }


def _evidence(**given: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    base = {"split_reads": zero, "discordant_pairs": zero, "assembly_contigs": zero, "soft_clips": zero, "mapq": zero, "vaf": F.lit(0.0), "raw_qual": vcf.to_float(F.col("qual")) if "raw_qual" not in given else zero}
    base |= {"filter_pass": F.col("filter") == "PASS" if "filter_pass" not in given else zero, "precise": F.col("info")["IMPRECISE"].isNull() if "precise" not in given else zero}
    return base | given


def parsed(lines: DataFrame, caller: str) -> DataFrame:
    """Breakpoint calls of one caller's lines (sample, line_no, line)."""
    if caller not in CALLERS:
        raise ValueError(f"unknown caller: {caller}")
    if caller == "factera":
        return _factera(lines)
    rows = written(records(lines), "records")  # filters and orders would work the maps out again
    info, fmt, kind = F.col("info"), F.col("fmt"), F.coalesce(F.col("info")["SVTYPE"], F.lit(""))
    n, x = vcf.to_int, vcf.element
    end = F.coalesce(vcf.to_int(info["END"]), F.col("pos"))
    end = F.when(info["END"].isNull(), F.col("pos")).otherwise(end)
    rows = rows.filter(info["SVTYPE"].isNotNull() if caller == "svaba" else kind == "BND" if caller == "gridss" else kind != "")
    is_bnd = kind == "BND"
    if caller in ("manta", "tiddit"):
        rows = _first_of_mates(rows, is_bnd, _mates())
    elif caller == "svaba":
        rows = _first_of_mates(rows, F.lit(True), _mates())
    elif caller == "gridss":
        rows = _first_of_mates(rows, F.lit(True), F.coalesce(F.nullif(info["EVENT"], F.lit("")), F.col("id")))
    rows = rows.withColumn("b", vcf.bnd(F.col("alt")))
    has = F.col("b").isNotNull()
    loose = F.col("filter").isin("PASS", ".")
    ci = lambda other: {"ci1": vcf.interval(info["CIPOS"]), "ci2": vcf.interval(F.coalesce(F.nullif(info[other], F.lit("")), info["CIPOS"]))}
    plus, minus = F.lit("+"), F.lit("-")
    if caller == "manta":
        rows = rows.filter(~is_bnd | has)
        ends = _bnd_or(is_bnd, (plus, F.col("chrom"), end, F.when(kind.isin("DEL", "DUP"), "-").otherwise("+"))) | ci("CIEND")
        digits = lambda t: F.when(x(t, -1).rlike(r"^\d+$"), n(x(t, -1))).otherwise(0).cast("long")
        proof = _evidence(split_reads=F.coalesce(digits(fmt["SR"]), F.lit(0)), discordant_pairs=F.coalesce(digits(fmt["PR"]), F.lit(0)), assembly_contigs=F.when(info["CONTIG"].isNotNull(), 1).otherwise(0).cast("long"), mapq=n(info["MAPQ"]), vaf=vcf.to_float(info["BND_DEPTH"]), filter_pass=loose)
        return _call(rows, caller, ends, proof, F.col("id"), kind)
    if caller == "gridss":
        rows = rows.filter(has)
        either = lambda k: n(F.coalesce(fmt[k], info[k]))
        proof = _evidence(
            split_reads=either("SR") + either("ASSR"), discordant_pairs=either("RP") + either("ASRP"), assembly_contigs=n(info["IC"]) + (n(info["AS"]) > 0).cast("long"), soft_clips=n(info["BSC"]),
            mapq=n(info["MQ"]), vaf=vcf.to_float(F.coalesce(fmt["AF"], info["AF"])),
        )
        return _call(rows, caller, _bnd_or(F.lit(True), (plus, F.col("chrom"), end, minus)) | ci("CIRPOS"), proof, F.coalesce(F.nullif(info["EVENT"], F.lit("")), F.col("id")), kind)
    if caller == "delly":
        rows = rows.filter(~is_bnd | has)
        first, second = (reduce(lambda c, kv: c.when(info["CT"] == kv[0], kv[1][side]), list(vcf.CT_STRANDS.items())[1:], F.when(info["CT"] == "3to5", vcf.CT_STRANDS["3to5"][side])).otherwise("+-"[side]) for side in (0, 1))
        dv, rv, dr, rr = (n(fmt[k]) for k in ("DV", "RV", "DR", "RR"))
        depth = dv + rv + dr + rr
        asm = (info["CONSBP"].isNotNull() | info["CONSENSUS"].isNotNull()).cast("long")
        proof = _evidence(split_reads=F.greatest(n(info["SR"]), rv), discordant_pairs=F.greatest(n(info["PE"]), dv), assembly_contigs=asm, mapq=n(info["MAPQ"]), vaf=F.when(depth > 0, (dv + rv) / depth).otherwise(0.0))
        return _call(rows, caller, _bnd_or(is_bnd, (first, F.col("chrom"), end, second)) | {"ci1": vcf.interval(info["CIPOS"]), "ci2": vcf.interval(info["CIEND"])}, proof, F.col("id"), kind)
    if caller == "svaba":
        how = info["EVDNC"]
        sr, dr = n(x(fmt["SR"], 1)), n(x(fmt["DR"], 1))
        split = F.when(how == "DSCRD", 0).when(how == "ASSMB", F.greatest(sr, F.lit(1))).otherwise(sr)
        paired = F.when(how == "DSCRD", F.greatest(dr, F.lit(1))).when(how == "ASSMB", 0).otherwise(dr)
        ad, dp = n(x(fmt["AD"], 1)), n(x(fmt["DP"], 1))
        asm = F.when(n(info["NUMPARTS"]) > 0, n(info["NUMPARTS"])).otherwise(F.coalesce(how.isin("ASDIS", "ASSMB"), F.lit(False)).cast("long"))
        proof = _evidence(split_reads=split.cast("long"), discordant_pairs=paired.cast("long"), assembly_contigs=asm, mapq=n(F.coalesce(info["MAPQ"], info["DISC_MAPQ"])), vaf=F.when(dp > 0, ad / dp).otherwise(0.0))
        return _call(rows, caller, _bnd_or(has, (plus, F.col("chrom"), end, minus)), proof, F.col("id"), kind)
    rows = rows.filter(~is_bnd | has)
    proof = _evidence(split_reads=n(F.coalesce(fmt["RV"], x(info["LTE"], 2))), discordant_pairs=n(F.coalesce(fmt["DV"], x(info["LTE"], 1))), filter_pass=loose)
    return _call(rows, caller, _bnd_or(is_bnd, (plus, F.col("chrom"), end, F.when(kind.isin("DEL", "TDUP", "DUP"), "-").otherwise("+"))), proof, F.col("id"), kind)


def _factera(lines: DataFrame) -> DataFrame:
    """Tabular: the first line that isn't blank names the columns. lines: Break1, Break2, Break_support1,
    Break_support2, Orientation by those names, or rows of text."""
    rows = fields(lines)
    of = ["sample", *[c for c in ("file",) if c in lines.columns]]
    head = rows.groupBy(*of).agg(F.min_by("f", "line_no").alias("head"), F.min("line_no").alias("first"))
    rows = rows.join(head, of).filter(F.col("line_no") > F.col("first"))
    names = ("Break1", "Break2", "Break_support1", "Break_support2", "Orientation")
    rows = rows.select("sample", "line_no", *[F.get(F.col("f"), F.array_position("head", F.lit(n)).cast("int") - 1).alias(n) for n in names])
    place = lambda name: (F.substring_index(name, ":", 1), F.substring_index(name, ":", -1).try_cast("bigint"))
    (c1, p1), (c2, p2) = place("Break1"), place("Break2")
    one, two = (vcf.to_int(F.col(f"Break_support{k}")) for k in (1, 2))
    turn = F.col("Orientation")
    s1, s2 = F.when(turn.isin("NN", "NC"), "+").otherwise("-"), F.when(turn.isin("NN", "CN"), "+").otherwise("-")
    support = F.when((one > 0) & (two > 0), F.least(one, two)).otherwise(F.greatest(one, two))
    rows = rows.withColumns({"b1": F.struct(c1.alias("c"), p1.alias("p")), "b2": F.struct(c2.alias("c"), p2.alias("p"))}).filter("b1.p is not null and b2.p is not null")
    (c1, p1), (c2, p2) = ((F.col(f"b{k}.c"), F.col(f"b{k}.p")) for k in (1, 2))
    yes, zero = F.lit(True), F.lit(0).cast("long")
    proof = {"split_reads": support, "discordant_pairs": zero, "assembly_contigs": F.lit(1).cast("long"), "soft_clips": zero, "mapq": zero, "vaf": F.lit(0.0), "raw_qual": F.lit(0.0), "filter_pass": yes, "precise": yes}
    name = F.concat_ws("_", F.lit("factera"), _strip(c1), p1.cast("string"), _strip(c2), p2.cast("string"))
    return _call(rows, "factera", {"c1": _strip(c1), "p1": p1, "s1": s1, "c2": _strip(c2), "p2": p2, "s2": s2}, proof, name, F.lit("BND"))


def parsed_all(by_caller: dict[str, DataFrame], files_before: int = 0) -> DataFrame:
    """All callers' calls. call_seq is unique, in the order of callers, then of samples and files, then of lines:
    lines (sample, line_no, line, and file where several files are of one sample) are numbered over all files, after ``files_before`` others."""
    unknown = set(by_caller) - set(CALLERS)
    if unknown:
        raise ValueError(f"unknown callers: {sorted(unknown)}")
    given = {c: by_caller[c] if "file" in by_caller[c].columns else by_caller[c].withColumn("file", F.lit("")) for c in CALLERS if c in by_caller}
    files = reduce(DataFrame.union, [d.select(F.lit(CALLERS.index(c)).alias("of_caller"), "sample", "file") for c, d in given.items()]).distinct()
    files = files.withColumn("file_ord", files_before + F.row_number().over(W.orderBy("of_caller", "sample", "file")).cast("long"))  # a row for each file
    parts = []
    for c, d in given.items():
        own = files.filter(F.col("of_caller") == CALLERS.index(c)).select(F.col("sample").alias("of_sample"), F.col("file").alias("of_file"), "file_ord")
        d = d.join(own, d["sample"].eqNullSafe(own["of_sample"]) & d["file"].eqNullSafe(own["of_file"]))
        numbered = d.select("sample", "file", (F.shiftleft("file_ord", LINE_BITS) + F.col("line_no")).alias("line_no"), "line")
        parts.append(parsed(numbered, c))
    return reduce(DataFrame.unionByName, parts).withColumn("call_seq", F.col("line_no"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        "record_id", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", "sv_type", "split_reads", "discordant_pairs", "assembly_contigs", "soft_clips", "mapq",
        F.round("vaf", 6).alias("vaf"), "raw_qual", "filter_pass", "precise",
    )


def lines_from_calls(calls: DataFrame, caller: str) -> DataFrame:
    """Records of text as the caller would write them, from calls; breakends of manta, svaba, gridss and
    tiddit with their mates."""
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: F.col(c).cast("string")
    seq, sr, pe = F.col("call_seq"), s("split_reads"), s("discordant_pairs")
    rid, flag = F.col("record_id"), F.when(~F.col("precise"), ";IMPRECISE").otherwise("")
    asm = F.col("assembly_contigs") > 0
    if caller == "factera":
        row = t("chr", F.col("chrom_a"), ":", s("pos_a"), "\t", "chr", F.col("chrom_b"), ":", F.when(seq % 13 == 0, "bad").otherwise(s("pos_b")), "\t", sr, "\t", pe, "\t", F.when(seq % 4 == 0, "NN").when(seq % 4 == 1, "NC").when(seq % 4 == 2, "CN").otherwise("CC"))
        rows = calls.filter(F.col("caller") == caller).select("sample", seq.alias("line_no"), row.alias("line"))
        head = calls.sparkSession.createDataFrame([(-1, "Break1\tBreak2\tBreak_support1\tBreak_support2\tOrientation")], "line_no long, line string")
        return rows.select("sample").distinct().join(head).select("sample", "line_no", "line").union(rows)  # one line for each sample
    bnd = F.col("sv_type") == "BND"
    filt = F.when(F.col("filter_pass"), "PASS").when(seq % 2 == 0, ".").otherwise("LowQ")
    alt1 = F.when(bnd, vcf.alt_of(F.col("strand_a"), F.col("strand_b"), t("chr", F.col("chrom_b")), F.col("pos_b"))).otherwise(t("<", F.col("sv_type"), ">"))
    alt2 = vcf.alt_of(F.col("strand_b"), F.col("strand_a"), t("chr", F.col("chrom_a")), F.col("pos_a"))
    end = F.when(bnd, "").otherwise(t(";END=", (F.col("pos_a") + 5000).cast("string")))
    shape = {
        "manta": (t(";CIPOS=-", (seq % 5).cast("string"), ",", (seq % 7).cast("string"), ";BND_DEPTH=", (seq % 50).cast("string"), F.when(asm, ";CONTIG=ACGT").otherwise("")), "GT:PR:SR", t("0/1:10,", pe, ":7,", sr)),
        "gridss": (t(";EVENT=e", rid, ";IC=", (seq % 3).cast("string"), ";AS=", (seq % 2).cast("string"), ";BSC=", (seq % 9).cast("string"), ";AF=0.25;MQ=50;;"), "GT:SR:ASSR:RP", t("0/1:", sr, ":2:", pe)),
        "delly": (t(";CT=", F.when(seq % 4 == 0, "3to5").when(seq % 4 == 1, "5to3").when(seq % 4 == 2, "3to3").otherwise("5to5"), ";PE=", pe, ";SR=", sr, ";MAPQ=60", F.when(asm, ";CONSENSUS=ACGT").otherwise("")), "GT:DR:DV:RR:RV", t("0/1:8:", (seq % 6).cast("string"), ":4:", (seq % 12).cast("string"))),
        "svaba": (t(";EVDNC=", F.when(seq % 3 == 0, "DSCRD").when(seq % 3 == 1, "ASSMB").otherwise("ASDIS"), ";NUMPARTS=", F.when(seq % 5 == 0, "2").otherwise("0"), ";MAPQ=", (seq % 61).cast("string")), "GT:AD:DP:SR:DR", t("0/1:", sr, ":40:", sr, ":", pe)),
        "tiddit": (t(";LTE=", pe, ",", sr), F.when(seq % 2 == 0, "GT:DV:RV").otherwise("GT"), t("0/1:", (seq % 10).cast("string"), ":", (seq % 8).cast("string"))),
    }[caller]
    more, form, sample = (x if isinstance(x, Column) else F.lit(x) for x in shape)
    mates = caller in ("manta", "gridss", "svaba", "tiddit")
    # Lines are told by twice the number of their call, which is shifted, as twice a long may be longer than a long; mates stay in order.
    record = lambda chrom, pos, name, alt, mate, k: F.struct((F.shiftleft(seq, 1) + k).alias("line_no"), t("chr", chrom, "\t", pos.cast("string"), "\t", name, "\tN\t", alt, "\t", s("raw_qual"), "\t", filt, "\tSVTYPE=", F.col("sv_type"), mate, end, flag, more, "\t", form, "\t", sample).alias("line"))
    one = record(F.col("chrom_a"), F.col("pos_a"), F.when(bnd & F.lit(mates), t(rid, ":1")).otherwise(rid), alt1, F.when(bnd & F.lit(mates), t(";MATEID=", rid, ":2")).otherwise(""), 0)
    two = record(F.col("chrom_b"), F.col("pos_b"), t(rid, ":2"), alt2, t(";MATEID=", rid, ":1"), 1)
    rows = calls.filter(F.col("caller") == caller).select("sample", F.explode(F.when(bnd & F.lit(mates), F.array(one, two)).otherwise(F.array(one))).alias("r"))
    return rows.select("sample", "r.line_no", "r.line")
