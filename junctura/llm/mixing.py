"""Mixing sources to target weights.

Targets come from water-filling: sources share the corpus's words by weight, none above
``MAX_EPOCHS`` times its own size. Within a source, documents lie in the order of a hash-random key;
the key's first hexadecimal digits make ranges, the ranges' sums are added up first, and only then
each range's own running sum, so a source that holds a third of all rows is spread over
``16 ** RANGE_DIGITS`` ranges. The source is cut at its exact budget: whole epochs first, then the
documents whose running sum fits; the one at the cut gives the words that are left.

Defined cases: a null text has size 0; null sources form one source, last in order; sources of size
0 have target 0; rows with equal ids are told apart by their size, and equal in both share a place in
an order that doesn't change their sum (``take`` tells them apart by source and text); an empty table gives an empty one; further columns are not
read. No random state: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RANGE_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source.

    With sources by rising room per weight, a source is full exactly if its room per weight is at
    most what the words left would give per weight left; those sums are whole numbers.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("room", F.col("source_size") * MAX_EPOCHS)
    everything = W.partitionBy()
    up = W.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    by = by.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.row_number().over(up).alias("place"),
    )
    full = F.col("room") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    by = by.withColumn("full", full)
    share = F.min(F.when(~F.col("full"), F.struct("place", "words_left", "weight_left"))).over(everything)
    by = by.withColumn("share", share)
    level = F.col("share.words_left").cast("double") * F.col("weight") / F.col("share.weight_left").cast("double")
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(level)
    return by.select("source", "source_size", target.alias("target"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), shared.n_words(F.col(text)).alias("size"))


def mix(sizes: DataFrame, *kept: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, before: ``sizes`` has doc_id, source and size, and is
    read twice (once for the sums by range), so it should be written. Columns ``kept`` are carried along."""
    goal = targets(sizes).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    rows = sizes.select(
        "doc_id", "size", *kept, F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("name"), _key(F.col("doc_id")).alias("key")
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    by_range = rows.groupBy("name", "range").agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    by_range = by_range.join(goal, "name")
    inside = W.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(by_range, ["name", "range"])
    before = F.col("range_before") + F.col("inside_before")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rows = rows.withColumn("before", before).withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        "before", "epochs", part.cast("long").alias("part"), *kept,
    )


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return mix(shared.written(sized(df, doc_id, text, source), "sizes"))


def take(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as the mix repeats it. The document at the cut
    is taken whole if at least half of it fits. Rows are found again by id, source and a hash of the text, so
    those that are equal in all three are taken alike (as often as the one taken most)."""
    names = df.columns
    own = [F.col(doc_id).alias("mix_id"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")).alias("mix_source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mix_text")]
    sizes = df.select(F.col(source).alias("source"), shared.n_words(F.col(text)).alias("size"), *own).withColumn("doc_id", F.col("mix_id"))
    taken = mix(shared.written(sizes, "sizes"), "mix_source", "mix_text")
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = taken.groupBy(F.col("doc_id").alias("id2"), F.col("mix_source").alias("source2"), F.col("mix_text").alias("text2")).agg(F.max(times).alias("times")).filter("times > 0")
    rows = df.select(*own, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    out = rows.join(taken, rows["mix_id"].eqNullSafe(taken["id2"]) & (rows["mix_source"] == taken["source2"]) & (rows["mix_text"] == taken["text2"]))
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
