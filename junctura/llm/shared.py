"""Helpers that the text operators share: the shared folder, written steps, ordered placement."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters that are none of these (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Aimed-at bytes of text in a partition placed by order.
ORDERED_BYTES = 32 << 20

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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/junctura/{name}-{next(_serial)}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost
    executor costs no more than its own unfinished tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a written step that no later step reads."""
    spark = df.sparkSession
    root = shared_folder(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/junctura/" in folder and os.path.basename(root) in folder:
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that split the rows of ``df`` evenly by ``key``.
    Only the key column is read; what reaches the driver is bounded by ``parts``."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10 * parts).alias("at")).first()
    return sorted({int(x) for x in row["at"] or []})


def ordered_parts(df: DataFrame) -> int:
    """How many partitions to place ``df`` in by order: from the size of what it reads, known before
    anything runs, and at least as many as a shuffle has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return max(-(-2 * known // ORDERED_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """The file system of a folder's address, and the folder's path in it; for workers as for the driver."""
    from pyarrow import fs

    if "://" not in uri:
        uri = ("file://" if not uri.startswith("file:") else "") + (uri if not uri.startswith("file:") else "file://" + uri[5:])
    return fs.FileSystem.from_uri(uri)


def put(system, path: str, data: bytes) -> None:
    """Write a file whole or not at all: under another name first, so a task that is lost or run twice
    leaves no part of a file."""
    system.create_dir(os.path.dirname(path), recursive=True)
    rough = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(rough) as f:
        f.write(data)
    system.move(rough, path)
