"""URL filter: explicit rules, and a tree of path templates for the URLs that no rule fits.

The URLs that a rule fits are the labelled ones. Per host, runs of digits in a path segment become
``<n>``, and a place in the tree (of URLs of one depth) where the chance that the next URL shows a
segment not seen before is estimated at more than one half (share of segments seen once, smoothed)
becomes ``*``. Then, at every level of the tree, sibling branches of one form (number, word, extension)
are compared by what their URLs show below that level: a branch whose templates below fit those of
all siblings together (chi-square, with a tolerance that grows with the branch, so that the size of the
table doesn't decide) and whose share of blocked labels doesn't differ from theirs is alike, and the
alike branches of a place are merged to one class, labelled or not. A class of templates is rejected
when the smoothed share of blocked among its labelled URLs is at least ``MIN_PURITY``; a class without
labelled URLs has the share of the smoothing, one half, and stays.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; an empty table gives an empty one; repeated rows are judged alike; any number of segments is
used; further columns of the input are neither read nor returned.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: Added to the URLs of a place when the chance of an unseen segment is estimated.
UNSEEN_SMOOTHING = 2
#: Normal quantile of the test that compares what lies below sibling branches.
FORM_Z = 3.09
#: Squared relative deviation per URL that siblings may show at any size.
TOLERANCE = 0.05
#: Normal quantile of the test that compares their labels.
MERGE_Z = 1.96
MIN_PURITY = 0.8
#: The rules of the query, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^(?:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shaped(df: DataFrame, page_id: str, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    host, path = parts(F.col(url))
    df = df.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    df = df.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    return df.withColumn("general", F.regexp_replace("path", "[0-9]+", "<n>"))


#: Columns that tell a place in the tree: the host's hash, the level, a hash of the segments above, the segment's form.
PLACE = ["hid", "k", "above", "form"]


def _told(*by: Column) -> Column:
    """128 bits of a segment at its place, as two longs: xor of those tells a whole path or a part of it."""
    return F.struct(F.xxhash64(F.lit(1), *by).alias("x"), F.xxhash64(F.lit(2), *by).alias("y"))


def _xor(c: str, over=None) -> Column:
    both = [F.bit_xor(f"{c}.{x}") for x in "xy"]
    return F.struct(*[F.coalesce(b if over is None else b.over(over), F.lit(0).cast("long")).alias(x) for b, x in zip(both, "xy", strict=True)])


def general_paths(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (host, general, pid, hid, d (segments), n, b, a), one row for each general path, added up where the URLs are
    read, and their segments (pid, k, value, told). A segment's row holds hashes of its path and host, not those
    themselves, so what is written grows with the length of a URL and not with its square."""
    count = lambda verdict: F.sum(F.when(F.col("hit.verdict") == verdict, 1).otherwise(0))
    paths = shapes.groupBy("host", "general").agg(F.count("*").alias("n"), count("block").alias("b"), count("allow").alias("a"))
    split = F.when(F.col("general") != "", F.split(F.expr("substring(general, 2)"), "/", -1)).otherwise(F.array().cast("array<string>"))
    paths = paths.select("*", F.md5(F.concat_ws("\n", "host", "general")).alias("pid"), F.md5("host").alias("hid"), F.size(split).alias("d"))
    paths = shared.written(paths, "paths")
    segments = paths.select("pid", "hid", "d", "n", F.posexplode(split).alias("k", "g"))
    places = segments.groupBy("hid", "d", "k", "g").agg(F.sum("n").alias("n"))
    places = places.groupBy("hid", "d", "k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"))
    wild = places.filter(2 * F.col("once") > F.col("n") + UNSEEN_SMOOTHING).select("hid", "d", "k", F.lit("*").alias("wild"))
    segments = segments.join(wild, ["hid", "d", "k"], "left").select("pid", "k", F.coalesce("wild", "g").alias("value"))
    return paths, shared.written(segments.withColumn("told", _told(F.col("k"), F.col("value"))), "segments")


def merged_branches(tree: DataFrame) -> DataFrame:
    """PLACE and value of the branches that are merged. tree: PLACE, value, below, n, b, a for each level of each
    template."""
    place = PLACE
    shown = tree.groupBy(*place, "value", "below").agg(*[F.sum(c).alias(c) for c in "nba"])
    branch = shown.groupBy(*place, "value").agg(F.sum("n").alias("own_n"), F.sum("b").alias("own_b"), F.sum("a").alias("own_a"))
    family = branch.groupBy(*place).agg(F.sum("own_n").alias("all_n"), F.sum("own_b").alias("all_b"), F.sum("own_a").alias("all_a"), F.count("*").alias("branches")).filter("branches > 1")
    kinds = shown.groupBy(*place, "below").agg(F.sum("n").alias("kind_n"))
    freedom = kinds.groupBy(*place).agg((F.count("*") - 1).alias("freedom"))
    family = family.join(freedom, place)
    rows = shown.join(kinds, [*place, "below"]).join(branch, [*place, "value"]).join(family, place)
    part = F.col("n").cast("double") * F.col("n") * F.col("all_n") / (F.col("own_n").cast("double") * F.col("kind_n"))
    one = [F.max(c).alias(c) for c in ("own_n", "own_b", "own_a", "all_b", "all_a", "freedom")]
    rows = rows.groupBy(*place, "value").agg((F.sum(part) - F.max("own_n")).alias("chi"), *one)
    free = F.greatest(F.col("freedom").cast("double"), F.lit(1.0))
    quantile = F.when(F.col("freedom") > 0, free * F.pow(1 - 2 / (9 * free) + FORM_Z * F.sqrt(2 / (9 * free)), F.lit(3.0))).otherwise(0.0)
    fits = F.col("chi") <= quantile + TOLERANCE * F.col("own_n") + 1e-9
    n, every = F.col("own_b") + F.col("own_a"), F.col("all_b") + F.col("all_a")
    share = F.col("all_b") / F.greatest(every, F.lit(1))
    off = F.pow(F.col("own_b") / F.greatest(n, F.lit(1)) - share, F.lit(2.0)) * n
    alike = rows.filter(fits & ((n == 0) | (off <= MERGE_Z**2 * share * (1 - share) + 1e-9))).select(*place, "value")
    several = alike.groupBy(*place).agg(F.count("*").alias("merged")).filter("merged > 1")
    return alike.join(several, place, "left_semi")


def templates(shapes: DataFrame) -> DataFrame:
    """host, general, template, rejected: for each host and general path its class of templates, and whether
    that is rejected. What is shuffled is counts by general path, and one small row for each of its segments."""
    paths, segments = general_paths(shapes)
    paths = paths.join(segments.groupBy("pid").agg(_xor("told").alias("tid")), "pid", "left")  # no segments: tid is null
    paths = shared.written(paths.withColumn("tid", F.coalesce("tid", _told(F.lit("")))), "templates")
    own = paths.groupBy("hid", "d", "tid").agg(*[F.sum(c).alias(c) for c in "nba"], F.min("pid").alias("pid"))
    tree = own.filter("d > 0").join(segments, "pid")
    kind = F.when(F.col("value") == "*", "*").when(F.contains("value", F.lit("<n>")), "n").when(F.col("value") == "", "").otherwise("w")
    down = W.partitionBy("pid").orderBy("k")  # the segments of one path
    rest = F.struct(*[(F.col(f"tid.{x}").bitwiseXOR(F.col(f"above.{x}"))).bitwiseXOR(F.col(f"told.{x}")).alias(x) for x in "xy"])
    tree = tree.withColumn("above", _xor("told", down.rowsBetween(W.unboundedPreceding, -1))).select(
        "pid", "hid", "k", "above", F.concat(kind, F.lit(":"), F.regexp_extract("value", r"\.[A-Za-z<>]*$", 0)).alias("form"), "value", F.struct("d", rest.alias("rest")).alias("below"), "n", "b", "a",
    )
    tree = shared.written(tree, "tree")
    merged = merged_branches(tree).withColumn("is_merged", F.lit(True))
    name = F.when(F.col("is_merged"), F.concat(F.lit("~"), F.col("form"))).otherwise(F.col("value"))
    named = tree.join(merged, [*PLACE, "value"], "left").select("pid", F.struct("k", name.alias("name")).alias("part"))
    named = named.groupBy("pid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["name"]), "/").alias("class"))  # as many as the path has segments
    own = shared.written(own.join(named, "pid", "left").withColumn("class", F.coalesce("class", F.lit(""))), "classes")
    share = (F.sum("b") + 1) / (F.sum("b") + F.sum("a") + 2)
    judged = own.groupBy("hid", "d", "class").agg((share >= MIN_PURITY).alias("rejected"))
    judged = own.select("hid", "d", "tid", "class").join(judged, ["hid", "d", "class"])
    template = F.when(F.col("d") > 0, F.concat(F.lit("/"), F.col("class"))).otherwise("")
    return paths.select("host", "general", "hid", "d", "tid").join(judged, ["hid", "d", "tid"]).select("host", "general", template.alias("template"), "rejected")


def judge(df: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict, template."""
    shapes = shaped(df, page_id, url, RULES if rules is None else rules)
    found = templates(shapes)
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return shapes.join(found, ["host", "general"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), method).alias("verdict"), "template",
    )
