"""Dimension tables, truth sets and call tables from files. Each row keeps ``ord``, its place in the file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import strip_chr
from ..functions.vcf import to_int
from ..sinks import vcf_out


def require(*paths: str) -> list[str]:
    """Local paths that are missing; addresses of other stores are left to Spark."""
    return [p for p in paths if "://" not in p and not Path(p).exists()]


def rows(spark: SparkSession, path: str) -> DataFrame:
    """ord, f (fields), head (names): a small tab-separated file with a header line; none if it is missing."""
    schema = "ord long, f array<string>, head array<string>"
    if require(path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")).filter((F.trim("line") != "") & ~F.col("line").startswith("##"))
    lines = lines.withColumn("f", F.split(F.regexp_replace("line", "^#", ""), "\t", -1)).select(F.col("ord").cast("long"), "f")
    head = lines.agg(F.min_by("f", "ord").alias("head"), F.min("ord").alias("first"))
    return lines.join(head).filter("ord > first").select("ord", "f", "head")  # one header


def field(name: str) -> Column:
    return F.get(F.col("f"), F.array_position("head", F.lit(name)).cast("int") - 1)


def _named(df: DataFrame, text: tuple[str, ...], whole: dict[str, str] | None = None) -> DataFrame:
    numbers = [to_int(field(n)).alias(a) for n, a in (whole or {}).items()]
    return df.select("ord", *[F.coalesce(F.trim(field(n)), F.lit("")).alias(n) for n in text], *numbers)


def loci(spark: SparkSession, path: str) -> DataFrame:
    out = _named(rows(spark, path), ("gene", "chrom", "strand", "role", "notes"), {"start": "start", "end": "stop"})
    return out.withColumn("chrom", strip_chr(F.col("chrom")))


def partners(spark: SparkSession, path: str) -> DataFrame:
    return _named(rows(spark, path), ("partner_a", "partner_b", "cytoband", "disease", "source", "notes"))


def artefacts(spark: SparkSession, path: str) -> DataFrame:
    out = _named(rows(spark, path), ("chrom", "notes"), {"start": "start", "end": "stop"})
    return out.withColumn("chrom", strip_chr(F.col("chrom")))


def truth(spark: SparkSession, path: str) -> DataFrame:
    names = ("sample_id", "cell_line", "cohort", "truth_class", "gene_a", "gene_b", "cytoband", "source", "notes")
    out = _named(rows(spark, path), names)
    return out.withColumn("truth_class", F.when(F.col("truth_class") == "", "confirmed").otherwise(F.col("truth_class")))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Samples by id; of repeated ids the last row counts. Missing ids are made of run and title."""
    out = _named(rows(spark, path), ("sample_id", "run", "title", "cell_line", "cohort", "ashm_expected", "coverage", "project"))
    made = F.replace(F.concat_ws("_", "run", "title"), F.lit(" "), F.lit("_"))
    out = out.withColumn("sample_id", F.when(F.col("sample_id") == "", made).otherwise(F.col("sample_id"))).withColumn("coverage", F.col("coverage").try_cast("double"))
    last = F.max_by(F.struct(*[c for c in out.columns if c != "sample_id"]), F.col("ord"))
    return out.groupBy("sample_id").agg(last.alias("v")).select("sample_id", "v.*")


def junction_support(spark: SparkSession, path: str, min_split: int = 0, min_pairs: int = 0) -> DataFrame:
    """sample, gene_a, gene_b of supported junctions: the column ``supported`` decides where it is there."""
    out = rows(spark, path).select("*", F.array_contains("head", "supported").alias("told"))
    counted = (to_int(field("sr_junction")) >= min_split) | (to_int(field("pe_junction")) >= min_pairs)
    yes = F.lower(F.trim(field("supported"))).isin("1", "true", "yes")
    out = out.filter(F.when(F.col("told"), yes).otherwise(counted))
    out = out.select(*[F.trim(field(n)).alias(n) for n in ("sample", "gene_a", "gene_b")])
    return out.filter("sample <> '' and gene_a <> '' and gene_b <> ''").distinct()


def replicate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """sample_1, sample_2 by lines with a tab, else a comma; # begins a comment."""
    if require(path):
        return spark.createDataFrame([], "sample_1 string, sample_2 string")
    line = F.trim("value")
    parts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(line, ","))
    out = spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(parts.alias("p")).filter(F.size("p") >= 2)
    return out.select(F.trim(F.get("p", F.lit(0))).alias("sample_1"), F.trim(F.get("p", F.lit(1))).alias("sample_2"))


def fusion_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls from a table as written; columns by name, unknown ones are left out."""
    names = list(vcf_out.COLUMNS)
    lines = spark.read.option("header", True).option("quote", "").csv(path, sep="\t", inferSchema=False)
    value = F.concat_ws("\t", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) if n in lines.columns else F.lit("") for n in names])
    return vcf_out.from_tsv(lines.select(value.alias("value")))
