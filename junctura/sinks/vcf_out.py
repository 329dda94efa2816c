"""Calls as variant records, tab-separated rows and JSON."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contigs import sort_rank
from ..functions.vcf import alt_of, percent
from ..sources.steps import folder_for, numbered, scope

#: Columns of a call in their written order, by kind.
COLUMNS = {
    "sample": "string", "fusion_id": "string", "tier": "string", "event_class": "string", "chrom_a": "string", "pos_a": "long", "strand_a": "string", "gene_a": "string",
    "region_a": "string", "chrom_b": "string", "pos_b": "long", "strand_b": "string", "gene_b": "string", "region_b": "string", "sv_type": "string", "n_callers": "long",
    "callers_supporting": "array<string>", "n_evidence_types": "long", "split_reads": "long", "discordant_pairs": "long", "assembly_contigs": "long", "soft_clips": "long",
    "vaf": "double", "raw_qual_max": "double", "driver_locus": "string", "known_partner": "boolean", "known_partner_source": "string", "precise": "boolean",
    "any_pass": "boolean", "in_frame": "boolean", "qc_flags": "array<string>", "member_record_ids": "array<string>",
}


def complete(calls: DataFrame) -> DataFrame:
    """All columns of a call, in order; those that are missing are empty."""
    empty = {"string": F.lit(""), "long": F.lit(0).cast("long"), "double": F.lit(0.0), "boolean": F.lit(None).cast("boolean"), "array<string>": F.array().cast("array<string>")}
    return calls.select(*[(F.col(c).cast(t) if c in calls.columns else empty[t]).alias(c) for c, t in COLUMNS.items()])


def _info(c: dict[str, Column], mate: Column, swap: bool) -> Column:
    """INFO in its fixed order; what is empty or unknown is left out."""
    near, far = ("gene_b", "gene_a") if swap else ("gene_a", "gene_b")
    pair = lambda key, value: F.when(value.cast("string") != "", F.concat(F.lit(key + "="), value.cast("string")))
    text = lambda key, name: pair(key, percent(c[name]))
    yes = lambda key, name: pair(key, c[name].cast("int"))
    listed = lambda key, name: pair(key, F.array_join(F.transform(c[name], percent), "|"))
    inside = (c["sv_type"] != "BND") & (c["chrom_a"] == c["chrom_b"])
    span = F.abs(c["pos_b"] - c["pos_a"])
    return F.concat_ws(
        ";", pair("SVTYPE", c["sv_type"]), pair("MATEID", mate), F.when(inside, pair("END", c["pos_b"])),
        F.when(inside, pair("SVLEN", F.when(c["sv_type"] == "DEL", -span).otherwise(span))), F.when(~c["precise"], "IMPRECISE"), pair("FF_TIER", c["tier"]),
        text("FF_EVENT_CLASS", "event_class"), text("FF_GENE_A", near), text("FF_GENE_B", far), text("FF_DRIVER_LOCUS", "driver_locus"), yes("FF_KNOWN_PARTNER", "known_partner"),
        text("FF_KP_SOURCE", "known_partner_source"), yes("FF_IN_FRAME", "in_frame"), pair("FF_N_CALLERS", c["n_callers"]), listed("FF_CALLERS", "callers_supporting"),
        pair("FF_N_EV_TYPES", c["n_evidence_types"]), pair("FF_SR", c["split_reads"]), pair("FF_PE", c["discordant_pairs"]), pair("FF_ASM", c["assembly_contigs"]),
        pair("FF_SC", c["soft_clips"]), pair("FF_VAF", F.when(c["vaf"] != 0, F.format_string("%.4f", c["vaf"])).otherwise("0.0")), yes("FF_PRECISE", "precise"),
        yes("FF_ANY_PASS", "any_pass"), listed("FF_QC_FLAGS", "qc_flags"), text("FF_FUSION_ID", "fusion_id"),
    )


def records(calls: DataFrame, mates: bool = True) -> DataFrame:
    """Variant records: two mates for a breakend (or, without ``mates``, its first end alone, by the call's own id), one
    record for an event within a contig."""
    calls = complete(calls)
    c = {n: F.col(n) for n in COLUMNS} | {"sv_type": F.when(F.col("sv_type") == "", "BND").otherwise(F.col("sv_type"))}
    shown = lambda x: F.when(x.startswith("chr"), x).otherwise(F.concat(F.lit("chr"), x))
    ca, cb = shown(c["chrom_a"]), shown(c["chrom_b"])
    pa, pb = F.greatest(F.lit(1), c["pos_a"]), F.greatest(F.lit(1), c["pos_b"])
    strand = lambda x: F.when(x == "", "+").otherwise(x)
    sa, sb = strand(c["strand_a"]), strand(c["strand_b"])
    alike = (sa == sb) & sa.isin("+", "-")
    turned = F.when(sa == "+", "-").otherwise("+")
    known = sa.isin("+", "-") & sb.isin("+", "-")
    mate_a, mate_b = F.when(alike, turned).when(known, sa).otherwise(sb), F.when(alike, turned).when(known, sb).otherwise(sa)
    quality = F.when(c["raw_qual_max"] != 0, F.format_string("%.1f", c["raw_qual_max"])).otherwise(".")
    flags = F.concat_ws(";", F.when(~c["any_pass"] & (c["n_callers"] <= 1), "LowQual"), F.when(c["tier"] == "T3", "T3"))
    sr, pe = F.greatest(c["split_reads"], F.lit(0)), F.greatest(c["discordant_pairs"], F.lit(0))
    sample = F.format_string("./.:%d:%d:.,%d:%d", sr, pe, sr + pe, sr + pe)
    record = lambda chrom, pos, name, alt, info: F.struct(chrom.alias("chrom"), pos.alias("pos"), name.alias("id"), alt.alias("alt"), info.alias("info"))
    one, two = F.concat("fusion_id", F.lit(".1")), F.concat("fusion_id", F.lit(".2"))
    whole = F.array(record(ca, pa, F.col("fusion_id"), F.concat(F.lit("<"), c["sv_type"], F.lit(">")), _info(c, F.lit(""), False)))
    alone = F.array(record(ca, pa, F.col("fusion_id"), alt_of(sa, sb, cb, pb), _info(c, F.lit(""), False)))
    both = F.array(
        record(ca, pa, one, alt_of(sa, sb, cb, pb), _info(c, two, False)), record(cb, pb, two, alt_of(mate_a, mate_b, ca, pa), _info(c, one, True))
    )
    is_mate = (c["sv_type"] == "BND") | (c["chrom_a"] != c["chrom_b"])
    out = calls.select(F.explode(F.when(is_mate, both if mates else alone).otherwise(whole)).alias("r"), quality.alias("qual"), F.when(flags == "", "PASS").otherwise(flags).alias("filter"), sample.alias("sample_value"))
    return out.select("r.chrom", "r.pos", "r.id", F.lit("N").alias("ref"), "r.alt", "qual", "filter", "r.info", F.lit("GT:SR:PE:AD:DP").alias("format"), "sample_value")


def in_file_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(sort_rank(F.col("chrom")), "pos", "id")


def body(rows: DataFrame) -> DataFrame:
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample_value"]
    return in_file_order(rows).select(F.concat_ws("\t", *[F.col(n).cast("string") for n in names]).alias("value"))


#: INFO keys with number and type, and what they say; symbolic alleles.
INFO_KEYS = {
    "SVTYPE": ("1", "String", "Type of event"), "MATEID": ("1", "String", "Record of the mate"), "END": ("1", "Integer", "End of the event"),
    "SVLEN": ("1", "Integer", "Length of the event"), "IMPRECISE": ("0", "Flag", "Ends are not exact"), "FF_TIER": ("1", "String", "Tier"),
    "FF_EVENT_CLASS": ("1", "String", "Class of the event"), "FF_GENE_A": ("1", "String", "Gene at this end"), "FF_GENE_B": ("1", "String", "Gene at the other end"),
    "FF_DRIVER_LOCUS": ("1", "String", "Driver and receptor loci at the ends"), "FF_KNOWN_PARTNER": ("1", "Integer", "1 if the pair of genes is known"),
    "FF_KP_SOURCE": ("1", "String", "Source of the known pair"), "FF_IN_FRAME": ("1", "Integer", "1 if the fusion is in frame"), "FF_N_CALLERS": ("1", "Integer", "Callers that support it"),
    "FF_CALLERS": ("1", "String", "Names of those callers"), "FF_N_EV_TYPES": ("1", "Integer", "Kinds of evidence"), "FF_SR": ("1", "Integer", "Split reads"),
    "FF_PE": ("1", "Integer", "Discordant pairs"), "FF_ASM": ("1", "Integer", "Assembled contigs"), "FF_SC": ("1", "Integer", "Soft-clipped reads"),
    "FF_VAF": ("1", "Float", "Share of the variant"), "FF_PRECISE": ("1", "Integer", "1 if the ends are exact"), "FF_ANY_PASS": ("1", "Integer", "1 if a caller passed it"),
    "FF_QC_FLAGS": ("1", "String", "Flags of the rewrite passes"), "FF_FUSION_ID": ("1", "String", "Id of the call"),
}
COPIED_AT_ONCE = 1 << 20
ALLELES = {"DEL": "Deletion", "DUP": "Duplication", "INV": "Inversion", "INS": "Insertion", "BND": "Breakend"}


def header(sample: str, contigs: list[str]) -> list[str]:
    lines = ["##fileformat=VCFv4.3", *(f"##contig=<ID={c}>" for c in contigs)]
    lines += [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in INFO_KEYS.items()]
    lines += [f'##ALT=<ID={k},Description="{d}">' for k, d in ALLELES.items()]
    lines += ['##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowQual,Description="One caller, which did not pass it">', '##FILTER=<ID=T3,Description="Lowest tier">']
    lines += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=SR,Number=1,Type=Integer,Description="Split reads">']
    lines += ['##FORMAT=<ID=PE,Number=1,Type=Integer,Description="Discordant pairs">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depth by allele">']
    return [*lines, '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def write_vcf(calls: DataFrame, folder: str, sample: str = "SAMPLE", compression: str = "gzip", mates: bool = True) -> None:
    """Part files in order of position; the first one holds the header."""
    rows = records(calls, mates)
    contigs = [r["chrom"] for r in in_file_order(rows.groupBy("chrom").agg(F.min("pos").alias("pos"), F.min("id").alias("id"))).select("chrom").collect()]
    top = calls.sparkSession.createDataFrame([(x,) for x in header(sample, contigs)], "value string").coalesce(1)
    top.union(body(rows)).write.option("compression", compression).text(folder)


def write_one_vcf(calls: DataFrame, path: str, sample: str = "SAMPLE", mates: bool = True) -> None:
    """One sorted file: gzip where its name ends in .gz, else text. Parts are sorted, formatted and compressed by tasks
    (gzip members may follow each other in a file); what is left for one task is to copy their finished bytes, a block at
    a time, under another name that is then changed."""
    spark = calls.sparkSession
    with scope(spark):
        parts = folder_for(spark, "vcf-parts")
        write_vcf(calls, parts, sample, "gzip" if path.endswith(".gz") else "none", mates)

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            at = lambda p: fs.FileSystem.from_uri(p if "://" in p else "file://" + os.path.abspath(p))
            (source, root), (target, to) = at(parts), at(path)
            names = sorted(f.path for f in source.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
            rough = f"{to}.{uuid.uuid4().hex}.rough"
            with target.open_output_stream(rough, compression=None) as out:
                for name in names:
                    with source.open_input_stream(name, compression=None) as part:
                        while block := part.read(COPIED_AT_ONCE):
                            out.write(block)
            target.move(rough, to)
            yield from batches

        spark.range(1, numPartitions=1).mapInArrow(joined, "id long").collect()


def _written(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "array<string>":
        return F.coalesce(F.array_join(c, ","), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def to_tsv(calls: DataFrame) -> DataFrame:
    """value: one row a call, fields as they are written."""
    return complete(calls).select(F.concat_ws("\t", *[_written(n, k) for n, k in COLUMNS.items()]).alias("value"))


def from_tsv(lines: DataFrame) -> DataFrame:
    """Calls from rows of ``value``: numbers default to 0, in_frame to null, empty list elements are dropped."""
    f = F.split("value", "\t", -1)

    def read(k: int, kind: str) -> Column:
        x = F.get(f, F.lit(k))
        if kind == "long":
            return F.coalesce(x.try_cast("double").cast("long"), F.lit(0))
        if kind == "double":
            return F.coalesce(x.try_cast("double"), F.lit(0.0))
        if kind == "boolean":
            return F.when(F.lit(list(COLUMNS)[k] != "in_frame") | (x != ""), F.lower(x) == "true")
        return F.filter(F.split(x, ","), lambda e: e != "") if kind == "array<string>" else x

    return lines.select(*[read(k, kind).alias(n) for k, (n, kind) in enumerate(COLUMNS.items())])


def write_tsv(calls: DataFrame, folder: str) -> None:
    rows = complete(calls)
    rows.select(*[_written(n, k).alias(n) for n, k in COLUMNS.items()]).write.option("header", True).option("quote", "").csv(folder, sep="\t", emptyValue="")


def write_json(calls: DataFrame, folder: str, array: bool = False) -> None:
    """One object a line; as an ``array``, the parts, one after the other, are one JSON array in the order of ids."""
    if not array:
        to_json(calls).write.text(folder)
        return
    with scope(calls.sparkSession):
        rows = numbered(complete(calls), [], ["sample", "fusion_id"], "place")
        rows = rows.select("place", F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value"))
        last = rows.agg(F.max("place").alias("last")).first()["last"]
        if last is None:
            rows = calls.sparkSession.createDataFrame([(0, "")], "place long, value string")
        value = F.concat(F.when(F.col("place") == 0, "[").otherwise(""), "value", F.when(F.col("place") == (last or 0), "]").otherwise(","))
        rows.orderBy("place").select(value.alias("value")).write.text(folder)


def to_json(calls: DataFrame) -> DataFrame:
    return complete(calls).select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value"))
