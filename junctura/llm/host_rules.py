"""Quality rules judged per document and per host.

Each document gets counts from its whole text and a base verdict. Failures of the rules are then
added up by host, the hosts' failure rates are shrunk towards an empirical beta prior, and the
verdict on the host is joined back to its documents. A host is rejected when its posterior leaves
little doubt (``DOUBT_Z`` standard deviations) that its rate has more than ``ODDS`` times the odds of
the prior's mean. Where hosts don't differ by more than chance, the prior is a point and none is
rejected. Everything is DataFrame functions.

Defined cases: a null text is an empty one (no words, so it fails the base rules); null hosts form
one host of their own; repeated rows are judged each by itself; an empty table gives an empty one;
further columns of the input are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document fails a symbol rule above this share of symbols per word character.
MAX_SYMBOL_PERCENT = 10
#: A document fails a line rule when more than this share of its lines are copies of earlier ones.
MAX_DUP_LINE_PERCENT = 30
#: A host goes when its failures have more than this many times the odds of the prior's mean ...
ODDS = 2.0
#: ... by this many standard deviations of its posterior.
DOUBT_Z = 1.96
#: The prior weighs at least as much as one document, also where hosts fail wholly or not at all.
LEAST_WEIGHT = 1.0
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def document_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text.

    Windows of eight words are told apart by a 64-bit hash within one text: hashes of one, two, four and
    eight words are each made of two of the half length. Only where not all windows differ are the hashes
    sorted with their places, and the stretches that repeated windows cover are added up.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), t.alias("t")).select(
        "doc_id",
        "host",
        shared.words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    span = 1
    while span < WINDOW:
        rest = F.slice("h", F.lit(1 + span), F.greatest(F.size("h"), F.lit(1)))
        step = step.withColumn("h", F.zip_with("h", rest, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    n_windows = F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))
    step = step.withColumn("h", F.slice("h", F.lit(1), n_windows))
    step = step.withColumn("n_kinds", F.size(F.array_distinct("h")))
    placed = F.transform("h", lambda x, k: F.struct(x.alias("hash"), k.alias("at")))
    step = step.withColumn("sorted", F.when(F.col("n_kinds") < F.size("h"), F.sort_array(placed))).drop("h")
    s = F.col("sorted")

    def place(x: Column, k: Column) -> Column:
        before, after = F.get(s, k - 1), F.get(s, k + 1)
        return F.when((x["hash"] == before["hash"]) | (x["hash"] == after["hash"]), x["at"])

    step = step.withColumn("places", F.sort_array(F.filter(F.transform(s, place), lambda x: x.isNotNull())))
    following = F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1)))
    covered = F.aggregate(
        F.zip_with("places", following, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return step.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_base(counts: DataFrame) -> DataFrame:
    """Adds base_failed, and failed: whether any rule fails."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    return counts.withColumn("base_failed", base).withColumn("failed", base | symbols | lines)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, n_failed: one row for each host, added up before anything is moved."""
    return judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))


def beta_prior(rates: DataFrame) -> tuple[float, float | None]:
    """Mean and weight (alpha + beta) of the prior, by moments over the hosts; the weight is None where hosts
    differ by no more than chance. One row reaches the driver."""
    total = rates.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("bad"), F.count("*").alias("hosts")).first()
    if not total["n"]:
        return 0.0, None
    mean = total["bad"] / total["n"]
    spread = rates.agg(F.sum(F.col("n") * F.pow(F.col("n_failed") / F.col("n") - F.lit(mean), 2)).alias("s")).first()["s"] / total["n"]
    extra = spread - mean * (1 - mean) * total["hosts"] / total["n"]  # what chance alone doesn't explain
    return mean, max((mean * (1 - mean) - spread) / extra, LEAST_WEIGHT) if extra > 0 else None


def host_verdicts(rates: DataFrame) -> DataFrame:
    """Adds host_rate (the posterior's mean) and host_rejected."""
    mean, weight = beta_prior(rates)
    if weight is None:
        return rates.withColumn("host_rate", F.lit(mean)).withColumn("host_rejected", F.lit(False))
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    doubt = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.lit(weight + 1)))
    limit = ODDS * mean / (1 - mean + ODDS * mean)
    return rates.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") - DOUBT_Z * doubt > limit)


def bad_hosts(judged: DataFrame) -> DataFrame:
    """bad_host, host_rejected (true). Written, so that their size is known before they are joined and Spark
    broadcasts them up to its threshold: documents needn't be moved for a few hosts."""
    bad = host_verdicts(host_rates(judged)).filter("host_rejected")
    return shared.written(bad.select(F.col("host").alias("bad_host"), "host_rejected"), "bad-hosts")


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rejected, kept.

    The counts are written once to the shared folder (a few numbers a document) and read for the
    rates and again for the result. Only rejected hosts are joined back; Spark broadcasts them if
    their known size allows and splits hot hosts otherwise.
    """
    judged = shared.written(with_base(document_counts(df, doc_id, text, host)), "rules")
    bad = bad_hosts(judged)
    out = judged.join(bad, judged["host"].eqNullSafe(bad["bad_host"]), "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns as they were. Rows are written with their
    verdicts, so neither repeated nor null ids matter, and no text is shuffled or counted twice."""
    names = df.columns
    packed = df.select(F.col(text).alias("text"), F.col(host).alias("host"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    judged = with_base(document_counts(packed, "row", "text", "host"))
    judged = shared.written(judged.select(F.col("doc_id").alias("row"), "host", "base_failed", "failed"), "judged")
    bad = bad_hosts(judged)
    good = judged.filter(~F.col("base_failed"))
    good = good.join(bad, good["host"].eqNullSafe(bad["bad_host"]), "left_anti")
    return good.select(*[F.col("row").getField(c).alias(c) for c in names])
