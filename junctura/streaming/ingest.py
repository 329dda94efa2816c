"""New caller files as they arrive: each batch adds its files' calls to what is known of their samples.

State lies in tables beside the result. ``calls`` holds the parsed calls by sample and file, ``files`` the files of each
batch, whose number before a batch gives its files their own numbers (so call_seq is unique over batches and the
same if a batch is run again). After a batch, the samples that it touched are worked out again from all their files,
each sample on its own, and replace their part of the result. So two batches of one sample give what one would, and a
batch that is run again changes nothing. What is told of the whole cohort (``recurrence``) is read from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..plans import pipeline
from ..sinks import vcf_out
from ..sources import callers
from ..sources.steps import scope, written

FILES_AT_ONCE = 1000


def _key(sample: Column) -> Column:
    """The sample's part of a table; its name may be anything."""
    return F.concat(F.lit("k"), F.md5(sample))


def _replace(df: DataFrame, folder: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)


def absorb(spark: SparkSession, paths: list[str], number: int, caller: str, loci: DataFrame, partners: DataFrame, artefacts: DataFrame, out: str, state: str) -> None:
    """Add the files of batch ``number`` (``<sample>.<anything>``) to the state, and renew their samples in ``out``."""
    files = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").coalesce(1)
    files.write.mode("overwrite").parquet(f"{state}/files/batch={number}")
    before = spark.read.schema("path string, batch long").parquet(f"{state}/files").filter(F.col("batch") < number).count()
    lines = callers.read_lines(spark, paths).withColumn("sample", F.regexp_extract("file", r"([^/]+?)\.[^/]*$", 1))
    with scope(spark):
        calls = written(callers.parsed_all({caller: lines}, before), "batch-calls")
        if calls.isEmpty():
            return
        _replace(calls.withColumns({"sample_key": _key(F.col("sample")), "file_no": F.shiftright("call_seq", callers.LINE_BITS)}), f"{state}/calls", "sample_key", "file_no")
        touched = calls.select(_key(F.col("sample")).alias("sample_key")).distinct()
        known = spark.read.parquet(f"{state}/calls").join(touched, "sample_key", "left_semi").select(*calls.columns)
        done = pipeline.final(written(known, "sample-calls"), loci, partners, artefacts, by_sample=True)
        _replace(vcf_out.complete(done).withColumn("sample_key", _key(F.col("sample"))), out, "sample_key")


def stream(spark: SparkSession, folder: str, caller: str, loci: DataFrame, partners: DataFrame, artefacts: DataFrame, out: str, checkpoint: str, state: str | None = None):
    """A query that turns files of one caller into calls in ``out``. The stream itself carries names only
    (``FILES_AT_ONCE`` a batch at most); files are read in blocks by lines."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", FILES_AT_ONCE)

    def handle(batch: DataFrame, number: int) -> None:
        if paths := [r["path"] for r in batch.select("path").collect()]:
            absorb(spark, paths, number, caller, loci, partners, artefacts, out, state or f"{out.rstrip('/')}-state")

    return files.load(folder).select("path").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recurrence(spark: SparkSession, out: str, window: int = 1000) -> DataFrame:
    """Cells that calls of several samples share, over all samples so far."""
    return reports.cohort_recurrence(spark.read.parquet(out), window)
