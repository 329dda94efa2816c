"""Results that are kept in a folder under a key of the files they were worked out from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Of the names, lengths and times of the files at ``paths``: their listing is hashed and added up by tasks, no
    file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    told = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    row = files.agg(F.count("*").alias("n"), F.sum(told.cast("decimal(38,0)")).alias("of")).first()
    return f"{row['n']}:{row['of']}"


def cached(spark: SparkSession, folder: str, paths: list[str], parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, from ``folder`` if it was made before from the same files with the same parameters. It is
    written under another name and renamed, so a run that ends early leaves nothing under the key, and of two runs
    at once the first to end counts."""
    key = hashlib.sha256(repr((fingerprint(spark, paths), sorted(parameters.items()))).encode()).hexdigest()[:32]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/kept-{key}")
    system = at.getFileSystem(conf)
    if not system.exists(at):
        rough = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/rough-{uuid.uuid4().hex}")
        make().write.parquet(rough.toString())
        if system.exists(at) or not system.rename(rough, at):
            system.delete(rough, True)
    return spark.read.parquet(at.toString())
