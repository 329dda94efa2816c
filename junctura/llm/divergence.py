"""Source divergence audit: how far the terms of a language's sources lie from each other.

Terms are runs of letters A to Z and of all code points beyond ASCII, lower-cased from A to Z. All is joins and
sums: matches are exploded once, with each text's distinct terms beside them, and added up by language, source
and term where the texts lie; that table gives the kept vocabulary of each language (terms in at least
``MIN_DOCS`` of its documents), the groups and their sums. Groups are crossed with the vocabulary of their
language, so zeros are rows too; a hash of the term goes into that join, as languages are few and large.
Sources are then compared in a join of that table with itself on language and term, of which each pair is made
once and given both ways.

All arithmetic is exact: counts may be multiplied by a thousand millions, so shares are worked out in decimals
of 38 digits.

Defined cases: null text, language or source is an empty one; a text without terms still makes its group; a
language without kept terms gives pairs with value 0 and no terms; each row is a document, whatever its id;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: What lies between terms (after lower-casing), and the scale of shares.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
IN_LONGS = 9_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
#: Parts of a language's vocabulary in the join with its groups.
SALTS = 256


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs: one row for each term of a group, and one with a null term for
    each group that has a text without terms."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = blank(text)
    ascii_only = F.octet_length(text) == F.length(text)  # there lower() changes A to Z only, and is faster
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    rows = df.select(blank(lang).alias("lang"), blank(source).alias("source"), F.split(lower, BETWEEN).alias("terms"))
    rows = rows.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("lang", "source", F.nullif("term", F.lit("")).alias("term")).agg(one(F.col("at") < F.col("size")).alias("n"), one(F.col("at") >= F.col("size")).alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + the whole part of SCALE * (count + 2) / (total + 2 * terms), in whole numbers; in decimals where the count is
    so large that the product isn't a long."""
    exact = lambda c: c.cast("decimal(28,0)")
    div = lambda x, y: F.call_function("div", x, y).cast("long")
    return F.when(count < IN_LONGS, div(F.lit(SCALE) * (count + 2), total + 2 * terms)).otherwise(div(F.lit(SCALE) * exact(count + 2), exact(total + 2 * terms))) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = shared.written(term_counts(df, text, lang, source), "term-counts")
    found = counts.filter("term is not null")
    vocabulary = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = shared.written(vocabulary, "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = shared.written(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "held-terms")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = shared.written(groups.select("lang", "source", none("total"), none("terms"), none("lang_total")), "groups")

    salted = kept.select("lang", "term").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = spread.join(salted, ["lang", "salt"]).join(held.drop("lang_n"), ["lang", "source", "term"], "left")
    own = lambda n: share(n, F.col("total"), F.col("terms")).alias("p")
    cells = cells.select("lang", "source", "term", own(F.coalesce("n", F.lit(0))))
    one = cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"))
    two = cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"))
    sums = one.join(two, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(apart(F.col("p_a"), F.col("p_b"))).alias("value"))
    bare = groups.filter("terms = 0").select("lang", F.col("source").alias("a"))
    bare = bare.join(bare.select("lang", F.col("a").alias("b")), "lang").filter("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    pairs = sums.union(bare).select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way"), "value")
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    shown = held.join(groups, ["lang", "source"])  # cells with occurrences only
    shown = shown.select("lang", "source", "term", own(F.col("n")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    terms = shown.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", place).union(terms.withColumn("rank", place).filter(F.col("rank") <= top))
