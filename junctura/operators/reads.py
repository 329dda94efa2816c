"""Aligned reads: filters, clips, and clusters of split and discordant reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import contigs
from ..sources.steps import numbered, written

#: Bits of a read's flag.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 256, 1024, 2048
#: The adapter and its reverse complement; the share of G or C from which a sequence is noise.
ADAPTER, ADAPTER_REVERSED = "AGATCGGAAGAGC", "GCTCTTCCGATCT"
HOMOPOLYMER = 0.70
WINDOW = 500
FULL_MAPQ = 30
ROWS_A_LOCUS = 5_000_000
#: Bases of a bin in which reads and windows meet.
BIN = 10_000


def bit(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) != 0


def usable(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    f = F.col("flag")
    return reads.filter(~bit(f, UNMAPPED) & ~bit(f, SECONDARY) & ~bit(f, DUPLICATE) & (F.col("mapq") >= min_mapq))


def mapq_weight(mapq: Column, full: int = FULL_MAPQ) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mapq / F.lit(full)))


def _points(mapq: Column, full: int = FULL_MAPQ) -> Column:
    """``mapq_weight`` in parts of ``full``: whole numbers, whose sum is the same in any order."""
    return F.least(F.lit(full), F.greatest(F.lit(0), mapq))


def _length(cigar: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(cigar, pattern, 1).try_cast("int"), F.lit(0))


def lead(cigar: Column, kinds: str = "SH") -> Column:
    return _length(cigar, rf"^(\d+)[{kinds}]")


def trail(cigar: Column, kinds: str = "SH") -> Column:
    return _length(cigar, rf"(\d+)[{kinds}]$")


def _side(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), ".").when(a >= b, "L").otherwise("R")


def _clip(a: Column, b: Column, seq: Column) -> Column:
    return F.when((a == 0) & (b == 0), "").when(a >= b, F.left(seq, a)).otherwise(F.right(seq, b))


def _aligned(a: Column, b: Column, seq: Column) -> Column:
    return F.substring(seq, a + 1, F.length(seq) - a - b)


def clip_side(cigar: Column) -> Column:
    """L or R, where the longer clip is (L of equals), or '.' without one."""
    return _side(lead(cigar), trail(cigar))


def clip_sequence(cigar: Column, seq: Column) -> Column:
    return _clip(lead(cigar, "S"), trail(cigar, "S"), seq)


def aligned_sequence(cigar: Column, seq: Column) -> Column:
    return _aligned(lead(cigar, "S"), trail(cigar, "S"), seq)


def hard_clipped(cigar: Column) -> Column:
    return cigar.rlike(r"\d+H")


def is_noise(seq: Column) -> Column:
    """Holds the beginning of an adapter, or is mostly G or mostly C; empty is not noise."""
    share = lambda base: (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))) / F.greatest(F.length(seq), F.lit(1))
    adapters = seq.contains(ADAPTER[:11]) | seq.contains(ADAPTER_REVERSED[:11])
    return (seq != "") & (adapters | (share("G") >= HOMOPOLYMER) | (share("C") >= HOMOPOLYMER))


def _read_noise(clip: Column, hard: Column, aligned: Column) -> Column:
    return F.when(clip != "", is_noise(clip)).when(hard, is_noise(aligned)).otherwise(F.lit(False))


def read_is_noise(cigar: Column, seq: Column) -> Column:
    return _read_noise(clip_sequence(cigar, seq), hard_clipped(cigar), aligned_sequence(cigar, seq))


def soft_clip_total(cigar: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)S"), F.lit(1)), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def supplementary(sa: Column) -> Column:
    """Alignments of an SA tag with at least four fields and a whole position, in order."""
    parts = F.transform(F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda p: p != ""), lambda p: F.split(p, ","))
    good = F.filter(parts, lambda p: (F.size(p) >= 4) & F.get(p, F.lit(1)).rlike(r"^-?\d+$"))
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("long").alias("pos"), F.get(p, F.lit(2)).alias("strand"), F.get(p, F.lit(3)).alias("cigar")))


def in_windows(reads: DataFrame, windows: DataFrame, pad: int = 0, rows: int | None = None) -> DataFrame:
    """Reads that overlap each padded window; a read in two windows comes twice. ``rows``, which no scan sets, keeps as many
    of a window at most, in order of read_id, counted before any filter.

    Contigs may be named with or without chr on either side: windows take the names that the reads' distinct contigs
    have. With ``rows``, reads are counted by window first (from four columns); only windows beyond it are cut, and those
    by ranges of read_id with running sums, so no window is one task."""
    near = contigs.as_named(windows.select("gene", "chrom", (F.col("start") - pad).alias("w_start"), (F.col("stop") + pad).alias("w_stop")), "chrom", reads.select("contig"))
    near = near.withColumnRenamed("chrom", "contig")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))).alias("bin")
    # Windows are written, so their size is known and reads aren't shuffled where windows are few. A read and a window that
    # overlap meet in the bin where the later of them begins, and count there only.
    near = written(near.select("*", bins("w_start", "w_stop")), "windows")
    hits = reads.select("*", bins("ref_start", "ref_end")).join(near, ["contig", "bin"])
    hits = hits.filter((F.col("ref_start") < F.col("w_stop")) & (F.col("ref_end") > F.col("w_start")) & (F.col("bin") == F.floor(F.greatest("ref_start", "w_start") / BIN))).drop("bin")
    if rows is None:
        return hits
    full = written(hits.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("gene"), "full-windows")
    if full.isEmpty():
        return hits
    first = numbered(hits.join(full, "gene", "left_semi"), ["gene"], ["read_id"], "place").filter(F.col("place") < rows).drop("place")
    return hits.join(full, "gene", "left_anti").unionByName(first)


def told(reads: DataFrame) -> DataFrame:
    """``reads`` with what cigar, sequence and SA tag tell, in place of these: side, noise (of the read), noisy (its aligned
    part) and others (its supplementary alignments). Written, as filters on what texts tell would work it out again and
    again, and each column leans on those before it, so a text is looked into once."""
    c, s, col = F.col("cigar"), F.col("seq"), F.col
    rows = reads.withColumns({f"told_{n}_{k}": f(c, kinds) for n, f in (("lead", lead), ("trail", trail)) for k, kinds in (("any", "SH"), ("soft", "S"))})
    soft = col("told_lead_soft"), col("told_trail_soft")
    rows = rows.withColumns({"told_clip": _clip(*soft, s), "told_aligned": _aligned(*soft, s), "told_hard": hard_clipped(c)})
    rows = rows.withColumns({
        "side": _side(col("told_lead_any"), col("told_trail_any")), "noise": _read_noise(col("told_clip"), col("told_hard"), col("told_aligned")), "noisy": is_noise(col("told_aligned")),
        "others": supplementary(col("sa")),
    })
    return written(rows.drop("cigar", "seq", "sa", *[n for n in rows.columns if n.startswith("told_")]), "told")


def split_supports(reads: DataFrame) -> DataFrame:
    """One row for each read (``told``) and key of its supplementary alignments (the first of a key, and of rows that share
    a read's name the first by place), noise left out."""
    side = F.col("side")
    strand = F.when(side == "L", "-").when(side == "R", "+").otherwise(".")
    rows = reads.filter(~F.col("noise")).select(
        "sample", "gene", "read_id", F.col("contig").alias("chrom_a"), F.when(side == "L", F.col("ref_start")).otherwise(F.col("ref_end")).alias("pos_a"),
        strand.alias("strand_a"), "mapq", _points(F.col("mapq")).alias("w"), F.posexplode("others").alias("k", "s"),
    )
    rows = rows.withColumns({"other_lead": lead(F.col("s.cigar")), "other_trail": trail(F.col("s.cigar"))})
    other = _side(F.col("other_lead"), F.col("other_trail"))
    rows = rows.select(
        "sample", "gene", "read_id", "chrom_a", "pos_a", "strand_a", "mapq", "w", "k", F.col("s.chrom").alias("chrom_b"), F.col("s.pos").alias("pos_b"),
        F.floor(F.col("s.pos") / WINDOW).alias("cell"), F.when(other == "L", "-").when(other == "R", "+").otherwise(".").alias("strand_b"),
    )
    keys = ["read_id", "sample", "gene", "chrom_a", "chrom_b", "cell", "strand_a", "strand_b"]  # the name first, as it tells rows apart soonest when sorted
    return rows.groupBy(*keys).agg(F.min(F.struct("k", "pos_a", "pos_b", "mapq", "w")).alias("v")).select(*keys, "v.pos_a", "v.pos_b", "v.mapq", "v.w")


def _cluster(rows: DataFrame, evidence: str) -> DataFrame:
    """Clusters by key. Reads are added up by place first, so a group holds a row for each of its places, however many reads
    it has; pos_a is the upper median of the reads' places."""
    keys = ["sample", "gene", "chrom_a", "chrom_b", "cell", "strand_a", "strand_b"]
    by_place = rows.groupBy(*keys, "pos_a").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("mapq").alias("q"), F.count("mapq").alias("n_q"), F.min(F.struct("read_id", "pos_b")).alias("first"),
    )
    out = by_place.groupBy(*keys).agg(
        (F.sum("w") / F.lit(FULL_MAPQ)).alias(evidence), F.sort_array(F.collect_list(F.struct("pos_a", "n"))).alias("places"), F.min("first")["pos_b"].alias("pos_b"),
        F.sum("n").alias("n_reads"), F.floor(F.try_divide(F.sum("q"), F.sum("n_q"))).cast("long").alias("mapq"),
    )
    # The place whose reads, with those before it, are the first to be more than half.
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(rows.schema["pos_a"].dataType).alias("at"))
    half = F.floor(F.col("n_reads") / 2)
    found = F.aggregate("places", start, lambda acc, p: F.struct((acc["seen"] + p["n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + p["n"] > half), p["pos_a"]).otherwise(acc["at"]).alias("at")))
    return out.select(*keys, evidence, found["at"].alias("pos_a"), "pos_b", "n_reads", "mapq")


def split_clusters(reads: DataFrame) -> DataFrame:
    return _cluster(split_supports(told(reads)), "weight")


def discordant_supports(reads: DataFrame, distance: int = 10_000) -> DataFrame:
    """Pairs of reads (``told``) whose mate lies on another contig or far away; reads that gave split support are left out."""
    f = F.col("flag")
    used = reads.filter(~F.col("noise") & (F.size("others") > 0)).select("sample", "gene", "read_id")
    rows = reads.filter(bit(f, PAIRED) & ~bit(f, MATE_UNMAPPED))
    rows = rows.filter((F.col("mate_contig") != F.col("contig")) | (F.abs(F.col("mate_start") - F.col("ref_end")) >= distance))
    strand = lambda mask: F.when(bit(f, mask), "-").otherwise("+")
    rows = rows.join(used, ["sample", "gene", "read_id"], "left_anti")
    return rows.select(
        "sample", "gene", "read_id", F.col("contig").alias("chrom_a"), F.col("mate_contig").alias("chrom_b"), F.floor(F.col("mate_start") / WINDOW).alias("cell"),
        strand(REVERSE).alias("strand_a"), strand(MATE_REVERSE).alias("strand_b"), F.col("ref_end").alias("pos_a"), F.col("mate_start").alias("pos_b"), "mapq",
        _points(F.col("mapq")).alias("w"),
    )


def discordant_clusters(reads: DataFrame, distance: int = 10_000) -> DataFrame:
    return _cluster(discordant_supports(told(reads), distance), "weight")


def scanned(reads: DataFrame, windows: DataFrame, min_mapq: int = 20, min_split: float = 3.0, min_pairs: float = 3.0, distance: int = 10_000, pad: int = 0) -> DataFrame:
    """Breakpoint calls from reads: split and discordant clusters of each window, of all its reads, that reach the minimum."""
    rows = told(usable(in_windows(reads, windows, pad), min_mapq))
    s = _cluster(split_supports(rows), "weight").filter(F.col("weight") >= min_split).withColumn("kind", F.lit("split"))
    d = _cluster(discordant_supports(rows, distance), "weight").filter(F.col("weight") >= min_pairs).withColumn("kind", F.lit("pair"))
    n = F.bround("weight").cast("long")
    is_split = F.col("kind") == "split"
    return s.unionByName(d).select(
        "sample", "gene", "kind", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", F.when(is_split, n).otherwise(0).cast("long").alias("split_reads"),
        F.when(is_split, 0).otherwise(n).cast("long").alias("discordant_pairs"), F.when(is_split, n).otherwise(0).cast("long").alias("soft_clips"), "mapq",
        is_split.alias("precise"),
    )


def artefact_clusters(reads: DataFrame, windows: DataFrame, min_mapq: int = 20, least: int = 5, pad: int = 200) -> DataFrame:
    """Split clusters of artefact windows, of all their reads: noisy aligned parts and alignments within 1 kb of the window
    go."""
    near = told(usable(in_windows(reads, windows, pad), min_mapq)).filter(~F.col("noisy"))
    s = split_supports(near).join(windows.select("gene", contigs.strip_chr(F.col("chrom")).alias("w_chrom"), "start", "stop"), "gene")
    s = s.filter((contigs.strip_chr(F.col("chrom_b")) != F.col("w_chrom")) | (F.col("pos_b") < F.col("start") - 1000) | (F.col("pos_b") > F.col("stop") + 1000))
    keys = ["sample", "gene", "chrom_a", "chrom_b", "cell", "strand_a", "strand_b"]
    in_order = F.sort_array(F.collect_list(F.struct("read_id", "pos_a")))
    by = s.groupBy(*keys).agg(F.count("*").alias("n"), F.floor(F.avg("mapq")).cast("long").alias("mapq"), F.element_at(in_order, (F.floor(F.count("*") / 2) + 1).cast("int"))["pos_a"].alias("pos_a"), F.min_by("pos_b", "read_id").alias("pos_b"))
    return by.filter(F.col("n") >= least)


#: The stretch that a library is sampled from, on the contigs of these names if they are longer.
STRETCH, STRETCH_CONTIGS = (30_000_000, 60_000_000), ("chr1", "1")


def library_sample(reads: DataFrame, sample_size: int = 100_000, min_mapq: int = 20) -> DataFrame:
    """Reads of one contig in the order of their places, up to the one that gives the last of ``sample_size`` insert
    sizes, and of 4 times as many reads and one at most. The contig is the first by ``STRETCH_CONTIGS``, else by name;
    a long one of those is read in ``STRETCH`` only. Adds insert (null where a read gives none) and is written.

    The order is over as many reads as that bound allows, however large the table is."""
    named = F.when(F.col("contig") == STRETCH_CONTIGS[0], 0).when(F.col("contig") == STRETCH_CONTIGS[1], 1).otherwise(2)
    first = reads.groupBy("contig").agg(F.max("ref_end").alias("stop")).orderBy(named, contigs.chrom_key(F.col("contig"))).first()
    rows = reads if first is None else reads.filter(F.col("contig").eqNullSafe(F.lit(first["contig"])))
    if first is not None and first["contig"] in STRETCH_CONTIGS and (first["stop"] or 0) > STRETCH[1]:
        rows = rows.filter((F.col("ref_end") > STRETCH[0]) & (F.col("ref_start") < STRETCH[1]))
    f, tlen = F.col("flag"), F.abs("tlen")
    plain = ~bit(f, UNMAPPED) & ~bit(f, SECONDARY) & ~bit(f, DUPLICATE) & ~bit(f, SUPPLEMENTARY)
    insert = F.when(plain & (F.col("mapq") >= min_mapq) & (tlen > 0) & (tlen < 100_000), tlen)
    rows = rows.orderBy("ref_start", "read_id").limit(4 * sample_size + 1).withColumns({"plain": plain, "insert": insert})
    order = W.orderBy("ref_start", "read_id")  # of 4 * sample_size + 1 rows at most
    rows = rows.withColumns({"place": F.row_number().over(order), "inserts_before": F.count("insert").over(order.rowsBetween(W.unboundedPreceding, -1))})
    return written(rows.filter(F.col("inserts_before") < sample_size), "library-sample")


def library_stats(reads: DataFrame, sample_size: int = 100_000) -> DataFrame:
    """One row: insert sizes (median, MAD, p95, p99), soft clips, mapping quality, shares of kinds of read."""
    rows = library_sample(reads, sample_size)
    looked_at = F.col("place") <= 4 * sample_size
    f, used = F.col("flag"), looked_at & F.col("plain")
    p = lambda c, q: F.percentile(c, F.lit(q))
    insert, clip, mapq = F.when(looked_at, F.col("insert")), F.when(used, soft_clip_total(F.col("cigar"))), F.when(used, F.col("mapq"))
    share = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    kept = ~bit(f, SUPPLEMENTARY) & ~bit(f, SECONDARY) & ~bit(f, UNMAPPED)
    out = rows.agg(
        F.count("*").alias("n_reads"), F.count(insert).alias("n_inserts"), p(insert, 0.5).alias("insert_median"), p(insert, 0.95).alias("insert_p95"), p(insert, 0.99).alias("insert_p99"),
        p(clip, 0.5).alias("clip_median"), p(clip, 0.95).alias("clip_p95"), p(mapq, 0.5).alias("mapq_median"), p(mapq, 0.1).alias("mapq_p10"),
        share(looked_at & bit(f, SUPPLEMENTARY)).alias("supplementary_share"), share(looked_at & kept & bit(f, DUPLICATE)).alias("duplicate_share"),
    )
    apart = rows.filter(looked_at).join(F.broadcast(out.select("insert_median"))).agg(p(F.abs(F.col("insert") - F.col("insert_median")), 0.5).alias("insert_mad"))  # one row
    out = out.join(apart)
    return out.withColumn("discordant_distance", F.when(F.col("insert_median") > 0, F.floor(F.col("insert_median") + 5 * F.col("insert_mad"))).otherwise(10_000).cast("long"))


#: call_seq of calls from reads begins here, above those of any file.
READS_SEQ = 1 << 62
ARTEFACT_LEAST = 5


def _ended(rows: DataFrame) -> DataFrame:
    """Ends named 1 and 2, without chr, in their canonical order."""
    rows = rows.withColumnsRenamed({f"{c}_{s}": f"{c}{k}" for k, s in ((1, "a"), (2, "b")) for c in ("chrom", "pos", "strand")})
    rows = rows.withColumns({f"chrom{k}": contigs.strip_chr(F.col(f"chrom{k}")) for k in (1, 2)})
    return contigs.with_ends(rows, *[F.col(f"{c}{k}") for k in (1, 2) for c in ("chrom", "pos", "strand")])


def as_calls(found: DataFrame, of_artefacts: DataFrame | None = None) -> DataFrame:
    """Clusters of reads (``scanned``, and ``artefact_clusters``) as breakpoint calls, which merge with the callers'
    calls: one call for the split and the discordant cluster of one window, cell and strands, and one for each
    artefact cluster. call_seq numbers them in the order of their keys, beyond those of files, so it is the same
    however often it is worked out."""
    keys = ["sample", "gene", "chrom_a", "chrom_b", "cell_b", "strand_a", "strand_b"]
    rows = found.withColumn("cell_b", F.floor(F.col("pos_b") / WINDOW))
    first = F.col("kind") == "split"  # the split cluster names the places, where there is one
    at = lambda c: F.coalesce(F.min(F.when(first, F.col(c))), F.min(c)).alias(c)
    rows = rows.groupBy(*keys).agg(
        at("pos_a"), at("pos_b"), *[F.max(c).alias(c) for c in ("split_reads", "discordant_pairs", "soft_clips", "mapq")], F.bool_or("precise").alias("precise")
    ).withColumn("caller", F.lit("reads")).withColumn("raw_qual", F.lit(0.0))
    if of_artefacts is not None:
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(of_artefacts.select(
            "sample", "gene", "chrom_a", "chrom_b", F.col("cell").alias("cell_b"), "strand_a", "strand_b", "pos_a", "pos_b", F.col("n").alias("split_reads"), zero.alias("discordant_pairs"),
            F.col("n").alias("soft_clips"), "mapq", F.lit(True).alias("precise"), F.lit("reads_artefact").alias("caller"), F.col("n").cast("double").alias("raw_qual"),
        ))
    rows = numbered(rows, [], ["caller", *keys], "place")
    zero = F.lit(0).cast("long")
    return _ended(rows).select(
        "sample", "caller", F.lit("BND").alias("sv_type"), *[f"{c}_{s}" for s in "ab" for c in ("chrom", "pos", "strand")], "split_reads", "discordant_pairs",
        zero.alias("assembly_contigs"), "soft_clips", "mapq", F.lit(0.0).alias("vaf"), "raw_qual", F.lit(True).alias("filter_pass"), "precise",
        F.concat_ws("_", "caller", "gene", F.col("place").cast("string")).alias("record_id"), (F.lit(READS_SEQ) + F.col("place")).alias("call_seq"),
    )


def artefact_windows(artefacts: DataFrame) -> DataFrame:
    """Artefact stretches as windows: gene names them."""
    return artefacts.select(F.concat_ws("_", F.lit("artefact"), "chrom", F.col("start").cast("string"), F.col("stop").cast("string")).alias("gene"), "chrom", "start", "stop").distinct()


def calls_of_reads(reads: DataFrame, windows: DataFrame, artefacts: DataFrame | None = None, pad: int = 0, distance: int = 10_000, min_mapq: int = 20, least: float = 3.0) -> DataFrame:
    """All calls that the reads give: of the windows, and of the artefact stretches."""
    odd = None if artefacts is None else artefact_clusters(reads, artefact_windows(artefacts), min_mapq, max(ARTEFACT_LEAST, int(least)))
    return as_calls(scanned(reads, windows, min_mapq, least, least, distance, pad), odd)
