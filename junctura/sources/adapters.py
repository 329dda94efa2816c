"""The driver's tables as breakpoint evidence: integer arithmetic in SQL that Spark and DuckDB both read.

Every view is made of all rows of its tables. The names of the tables are put in by ``str.format``;
``{div}`` is whole-number division.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .steps import written

#: call_seq in ``RAW_CALLS``: the keys of a line as one number, which no long holds from 18 million orders on.
PACKED = "((((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 10007 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT))"
#: What that number is made of: an upper part, worth this much, and a lower part below it.
UPPER = 100003 * 10007 * 64
#: All numbers by which queries take remainders of call_seq divide this.
REMAINDERS = math.lcm(*range(2, 14), 50, 61, 400)
LONGEST = (1 << 63) - 1

RAW_CALLS = """
SELECT ((((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 10007 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT)) AS call_seq,
       concat('S', CAST(l_orderkey % 14 AS STRING)) AS sample,
       CASE l_linenumber WHEN 1 THEN 'manta' WHEN 2 THEN 'gridss' WHEN 3 THEN 'delly' WHEN 4 THEN 'svaba' WHEN 5 THEN 'tiddit'
            WHEN 6 THEN 'factera' ELSE 'native' END AS caller,
       CASE WHEN l_linenumber % 5 = 3 THEN 'DEL' ELSE 'BND' END AS sv_type,
       CAST(l_partkey % 400 % 22 + 1 AS STRING) AS chrom1,
       CAST((l_partkey % 400 * 7 + 2) % 22 + 1 AS STRING) AS chrom2,
       10000000 + l_partkey % 400 * 100000 + (l_orderkey * 37 + l_partkey * 11) % 1500 AS pos1,
       20000000 + l_partkey % 400 * 50000 + (l_orderkey * 53 + l_suppkey * 29) % 1500 AS pos2,
       CASE WHEN l_suppkey % 4 < 2 THEN '+' ELSE '-' END AS strand1,
       CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand2,
       CAST(l_quantity AS BIGINT) % 20 AS split_reads,
       CAST(floor(l_extendedprice) AS BIGINT) % 15 AS discordant_pairs,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS assembly_contigs,
       CAST(CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) % 20 ELSE 0 END AS BIGINT) AS soft_clips,
       l_linestatus = 'O' AS filter_pass, l_returnflag <> 'A' AS precise, l_discount AS vaf, l_quantity AS raw_qual
FROM {lineitem}
"""

#: R loci are receptors; those whose calls have both ends on one contig, near each other, hold both (calls within one locus).
#: Some loci lie away from every call (50, 20 or 40 kb), so that there are calls without a gene at an end.
LOCI = """
SELECT concat('G', CAST(p_partkey % 400 AS STRING)) AS gene, CAST(p_partkey % 400 % 22 + 1 AS STRING) AS chrom,
       10000000 + p_partkey % 400 * 100000 + p_size * 10 + CASE WHEN p_partkey % 400 % 7 = 0 THEN 50000 ELSE 0 END AS start,
       10000000 + p_partkey % 400 * 100000 + p_size * 10 + 800 + CASE WHEN p_partkey % 400 % 7 = 0 THEN 50000 ELSE 0 END AS stop,
       CASE p_partkey % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'IG_locus' ELSE 'rearr_hotspot' END AS role, p_partkey * 3 AS ord
FROM {part}
UNION ALL
SELECT concat('H', CAST(p_partkey % 400 AS STRING)), CAST((p_partkey % 400 * 7 + 2) % 22 + 1 AS STRING),
       20000000 + p_partkey % 400 * 50000 + p_size * 10 + CASE WHEN p_partkey % 400 % 3 = 0 THEN 20000 ELSE 0 END,
       20000000 + p_partkey % 400 * 50000 + p_size * 10 + 700 + CASE WHEN p_partkey % 400 % 3 = 0 THEN 20000 ELSE 0 END,
       CASE p_partkey % 2 WHEN 0 THEN 'driver' ELSE 'IG_locus' END, p_partkey * 3 + 1
FROM {part}
UNION ALL
SELECT concat('X', CAST(p_partkey % 400 AS STRING)), CAST(p_partkey % 400 % 22 + 1 AS STRING),
       10000000 + p_partkey % 400 * 100000 - 2000 - CASE WHEN p_partkey % 400 % 5 = 0 THEN 0 ELSE 40000 END,
       10000000 + p_partkey % 400 * 100000 - 1000 - CASE WHEN p_partkey % 400 % 5 = 0 THEN 0 ELSE 40000 END, 'driver', p_partkey * 3 + 2
FROM {part}
UNION ALL
SELECT concat('R', CAST(p_partkey % 400 AS STRING)), CAST(p_partkey % 400 % 22 + 1 AS STRING),
       CASE WHEN p_partkey % 400 % 11 = 7 AND abs(p_partkey % 400 * 50000 - 10000000) <= 400000 THEN least(10000000 + p_partkey % 400 * 100000, 20000000 + p_partkey % 400 * 50000) ELSE 1000000 + p_partkey % 400 * 1000 END,
       CASE WHEN p_partkey % 400 % 11 = 7 AND abs(p_partkey % 400 * 50000 - 10000000) <= 400000 THEN greatest(10000000 + p_partkey % 400 * 100000, 20000000 + p_partkey % 400 * 50000) + 1500 ELSE 1000500 + p_partkey % 400 * 1000 END,
       'IG_locus', p_partkey + 3000000000
FROM {part}
"""

PARTNERS = """
SELECT concat(CASE WHEN p_partkey % 400 % 4 = 0 THEN 'H' ELSE 'U' END, CAST(p_partkey % 400 AS STRING)) AS partner_a, concat('G', CAST(p_partkey % 400 AS STRING)) AS partner_b,
       CASE WHEN p_partkey % 8 = 0 THEN 'canonical' ELSE 'rare' END AS source,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('D', CAST(p_partkey % 5 AS STRING)) END AS disease, min(p_partkey) AS ord
FROM {part} GROUP BY 1, 2, 3, 4
UNION ALL
SELECT concat('G', CAST(p_partkey % 400 AS STRING)), concat(CASE WHEN p_partkey % 400 % 8 = 0 THEN 'H' ELSE 'V' END, CAST(p_partkey % 400 AS STRING)), 'later', 'Z', min(p_partkey) + 1000000000
FROM {part} GROUP BY 1, 2
"""

ARTEFACTS = """
SELECT CAST(p_partkey % 400 % 22 + 1 AS STRING) AS chrom, 10000000 + p_partkey % 400 * 100000 + 200 - CASE WHEN p_partkey % 400 % 29 = 0 THEN 0 ELSE 30000 END AS start,
       10000000 + p_partkey % 400 * 100000 + 600 - CASE WHEN p_partkey % 400 % 29 = 0 THEN 0 ELSE 30000 END AS stop
FROM {part}
"""

TRUTH = """
SELECT DISTINCT concat('S', CAST(o_orderkey % 16 AS STRING)) AS sample_id,
       CASE WHEN o_orderstatus = 'P' THEN 'none_expected' WHEN o_orderpriority LIKE '1%' THEN 'disputed'
            WHEN o_orderpriority LIKE '2%' THEN 'likely' WHEN o_orderpriority LIKE '3%' THEN 'driver_focal' ELSE 'confirmed' END AS truth_class,
       CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE concat('H', CAST(o_custkey % 400 AS STRING)) END AS gene_a,
       concat('G', CAST(o_custkey % 400 AS STRING)) AS gene_b
FROM {orders}
"""

JUNCTIONS = """
SELECT DISTINCT concat('S', CAST(o_orderkey % 16 AS STRING)) AS sample, concat('G', CAST(o_custkey % 400 AS STRING)) AS gene_a,
       concat('H', CAST(o_custkey % 400 AS STRING)) AS gene_b, o_orderkey % 4 AS sr_junction, o_orderkey % 3 AS pe_junction
FROM {orders}
"""

METADATA = """
SELECT concat('S', CAST(n_nationkey AS STRING)) AS sample_id, n_name AS cell_line,
       CASE r_name WHEN 'AFRICA' THEN 'PMBL' WHEN 'AMERICA' THEN ' dlbcl ' WHEN 'ASIA' THEN 'PTCL' WHEN 'EUROPE' THEN 'T-cell NHL' ELSE '' END AS cohort
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

READS = """
SELECT event_id AS read_id, concat('S', CAST(user_id % 5 AS STRING)) AS sample, CAST(user_id % 6 + 1 AS STRING) AS contig,
       1000000 + user_id % 6 * 100000 + event_id * 7 % 3000 AS ref_start, 1000000 + user_id % 6 * 100000 + event_id * 7 % 3000 + 100 AS ref_end,
       event_id * 13 % 61 AS mapq,
       (CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END) + (CASE WHEN event_id % 19 = 0 THEN 256 ELSE 0 END) + (CASE WHEN event_id % 23 = 0 THEN 1024 ELSE 0 END)
         + (CASE WHEN event_id % 29 = 0 THEN 2048 ELSE 0 END) + (CASE WHEN event_id % 10 < 9 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 31 = 0 THEN 8 ELSE 0 END)
         + (CASE WHEN event_id % 2 = 0 THEN 16 ELSE 0 END) + (CASE WHEN event_id % 4 < 2 THEN 32 ELSE 0 END) AS flag,
       CASE event_id % 6 WHEN 0 THEN '30S70M' WHEN 1 THEN '70M30S' WHEN 2 THEN '100M' WHEN 3 THEN '20H60M20S' WHEN 4 THEN '40S50M10S' ELSE '25H75M' END AS cigar,
       CASE event_id % 7 WHEN 0 THEN concat(repeat('G', 80), repeat('A', 20)) WHEN 1 THEN concat('AGATCGGAAGAGC', repeat('ACGT', 22))
            WHEN 2 THEN concat(repeat('ACGT', 20), 'GCTCTTCCGATCTAAAAAAA') ELSE repeat('ACGTT', 20) END AS seq,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE 200 + event_id * 11 % 700 END AS tlen,
       CAST((user_id * 5 + event_id % 3) % 6 + 1 AS STRING) AS mate_contig, 1500000 + event_id % 4 * 20000 + event_id * 3 % 700 AS mate_start,
       CASE WHEN event_id % 5 < 3 THEN concat(CAST(event_id % 4 + 1 AS STRING), ',', CAST(2000000 + event_id % 3 * 5000 + event_id % 90 AS STRING),
              CASE WHEN event_id % 2 = 0 THEN ',+,' ELSE ',-,' END, CASE WHEN event_id % 3 = 0 THEN '30M70S' ELSE '60S40M' END, ',60,1;',
              CASE WHEN event_id % 10 = 1 THEN 'bad,x,+,10M,1,1;' WHEN event_id % 10 = 2 THEN '2,2000050,-,50S50M,30,0;' ELSE '' END) ELSE '' END AS sa
FROM {events}
"""

WINDOWS = """
SELECT concat('L', CAST(r_regionkey + 1 AS STRING)) AS gene, CAST(r_regionkey + 1 AS STRING) AS chrom,
       1000000 + r_regionkey * 100000 AS start, 1000000 + r_regionkey * 100000 + 1800 AS stop, r_regionkey AS ord FROM {region}
UNION ALL
SELECT 'L1b', '1', 1001500, 1003000, 9 FROM {region} WHERE r_regionkey = 0
"""

ALL = {
    "raw_calls": RAW_CALLS, "loci": LOCI, "partners": PARTNERS, "artefacts": ARTEFACTS, "truth": TRUTH, "junctions": JUNCTIONS, "metadata": METADATA,
    "reads": READS, "windows": WINDOWS,
}
TABLES = ("lineitem", "part", "orders", "nation", "region", "events")


def for_duckdb(name: str) -> str:
    return ALL[name].format(div="//", **{t: t for t in TABLES})


def _carried(lines: DataFrame) -> DataFrame:
    """``lines`` with the upper and lower part of their packed number; rows of them are in its order."""

    def over(c: Column, most: int) -> Column:
        return F.floor((c - F.pmod(c, F.lit(most))) / most)  # exact below 2^53 lines, parts and suppliers

    quantity = F.col("l_quantity").cast("long")
    lines = lines.withColumn("packed_supp", F.col("l_suppkey") + over(quantity, 64))
    lines = lines.withColumn("packed_part", F.col("l_partkey") + over(F.col("packed_supp"), 10007))
    lines = lines.withColumn("packed_upper", F.col("l_orderkey") * 8 + F.col("l_linenumber") + over(F.col("packed_part"), 100003))
    low = (F.pmod("packed_part", F.lit(100003)) * 10007 + F.pmod("packed_supp", F.lit(10007))) * 64 + F.pmod(quantity, F.lit(64))
    return lines.withColumn("packed_lower", low).drop("packed_supp", "packed_part")


def _in_packed_order(lines: DataFrame) -> DataFrame:
    """``lines`` (``_carried``) with call_seq, a long in the order of the packed numbers and with their remainders, and
    packed, their digits. Lines are dealt into ranges and sorted there; the rows of the ranges before and the place in
    its own give a line's place among all."""
    ends = ["packed_upper", "packed_lower"]
    lines = lines.repartitionByRange(*ends).sortWithinPartitions(*ends).withColumn("row_no", F.monotonically_increasing_id())
    lines = written(lines, "lines").withColumns({"range_no": F.shiftright("row_no", 33), "place": F.col("row_no").bitwiseAND((1 << 33) - 1)})
    earlier = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = lines.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("range_before"))
    rest = F.pmod(F.pmod("packed_upper", F.lit(REMAINDERS)) * (UPPER % REMAINDERS) + F.col("packed_lower"), F.lit(REMAINDERS))
    digits = F.col("packed_upper").cast("decimal(20,0)") * F.lit(UPPER).cast("decimal(12,0)") + F.col("packed_lower")
    lines = lines.join(F.broadcast(before), "range_no").withColumn("call_seq", (F.col("range_before") + F.col("place")) * REMAINDERS + rest)
    return lines.withColumn("packed", digits.cast("string"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name``. Where a call's packed number is longer than a long (its SQL ends with an error there), raw_calls has
    call_seq in the order of these numbers, with the remainders that queries take of them, and their digits as packed."""
    text = ALL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if name == "raw_calls":
        lines = frames["lineitem"]
        lines = _carried(lines.select(*[c for c in lines.columns if c in text]))
        last = lines.agg(F.max(F.struct("packed_upper", "packed_lower"))).first()[0]
        if last is not None and last[0] is not None and last[0] * UPPER + last[1] > LONGEST:
            text, frames = text.replace(f"{PACKED} AS call_seq", "call_seq, packed"), {"lineitem": _in_packed_order(lines)}
    return spark.sql(text.replace("{div}", "div"), **frames)
