"""Written steps: a table that several plans read is written once to the folder that executors share."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_serial = itertools.count()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests), and an
    error on a cluster, whose executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "at" not in _own_folder:
        _own_folder["at"] = tempfile.mkdtemp(prefix="junctura-")
        atexit.register(shutil.rmtree, _own_folder["at"], ignore_errors=True)
    return "file://" + _own_folder["at"]


#: Folders of steps that are still there.
_kept: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Steps that are written inside are removed at its end: put the writing of the result inside."""
    before = set(_kept)
    try:
        yield
    finally:
        for folder in set(_kept) - before:
            _delete(spark, folder)
            _kept.discard(folder)


def discard(df: DataFrame) -> None:
    """Remove a written step that no later step reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if (known := next((k for k in _kept if k.rpartition("/")[2] == folder.rpartition("/")[2]), None)) is not None:
            _delete(df.sparkSession, known)
            _kept.discard(known)


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder's name for a step, which ``scope`` removes."""
    path = f"{shared_folder(spark)}/junctura/{name}-{next(_serial)}-{uuid.uuid4().hex[:12]}"
    _kept.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again: its plan ends there, and a lost executor costs its own tasks only."""
    spark = df.sparkSession
    path = folder_for(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in its group ``by``, in ``order`` (rows that are equal there come in any
    order, once and for all). Rows are written with a number of their own; of these only the keys are dealt into ranges of
    group and order, and a running sum over ranges and a window in each range give the place, so a group that holds
    most rows is many tasks and whole rows move once."""
    rows = written(df.withColumn("row_no", F.monotonically_increasing_id()), "rows")
    part = F.spark_partition_id().alias("range_no")
    keys = written(rows.select(*by, *order, "row_no").repartitionByRange(*[F.col(c) for c in (*by, *order, "row_no")]).select("*", part), "ranges")
    counts = keys.groupBy(*by, "range_no").agg(F.count("*").alias("range_n"))
    earlier = W.partitionBy(*by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    counts = counts.select(*[F.col(c).alias(f"range_{k}") for k, c in enumerate(by)], F.col("range_no").alias("range_at"), F.coalesce(F.sum("range_n").over(earlier), F.lit(0)).alias("range_before"))
    same = F.col("range_no") == F.col("range_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"range_{k}"))
    inside = F.row_number().over(W.partitionBy(*by, "range_no").orderBy(*order, "row_no")) - 1
    places = keys.withColumn("range_place", inside).join(counts, same).select("row_no", (F.col("range_before") + F.col("range_place")).alias(name))
    return rows.join(places, "row_no").select(*df.columns, name)
