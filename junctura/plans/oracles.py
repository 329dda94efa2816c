"""DuckDB SQL for the catalogue's queries, written apart from the operators: common table expressions that
build on each other, and a SELECT for each query."""

from __future__ import annotations

from ..operators.qc import SHORT_RANGE_EXEMPT
from ..sources.adapters import for_duckdb

_SWAP = "(CAST(chrom1 AS INT), pos1) > (CAST(chrom2 AS INT), pos2)"


def _pick(a: str, b: str) -> str:
    return f"CASE WHEN {_SWAP} THEN {b} ELSE {a} END"


CALLS = f"""
raw AS ({for_duckdb("raw_calls")}),
calls AS (SELECT *, concat('r', call_seq) AS record_id, {_pick("chrom1", "chrom2")} AS chrom_a, {_pick("pos1", "pos2")} AS pos_a, {_pick("strand1", "strand2")} AS strand_a,
  {_pick("chrom2", "chrom1")} AS chrom_b, {_pick("pos2", "pos1")} AS pos_b, {_pick("strand2", "strand1")} AS strand_b FROM raw)"""


def _components(strands: bool) -> str:
    keys = ["sample", "chrom_a", "chrom_b"] + ["strand_a", "strand_b"] * strands
    same = " AND ".join(f"x.{k} = y.{k}" for k in keys)
    return f""",
edge AS (SELECT x.call_seq AS a, y.call_seq AS b FROM calls x JOIN calls y ON {same} AND x.call_seq <> y.call_seq AND abs(x.pos_a - y.pos_a) <= 250 AND abs(x.pos_b - y.pos_b) <= 250),
reach AS (SELECT a AS call_seq, a AS stop_at FROM edge UNION SELECT reach.call_seq, edge.b FROM reach JOIN edge ON edge.a = reach.stop_at),
cid AS (SELECT c.call_seq, least(c.call_seq, coalesce(min(stop_at), c.call_seq)) AS cluster_id FROM calls c LEFT JOIN reach USING (call_seq) GROUP BY c.call_seq)"""


CLUSTERS = (
    CALLS
    + _components(True)
    + """,
member AS (SELECT cluster_id, calls.*, row_number() OVER w AS place, count(*) OVER (PARTITION BY cluster_id) AS n_members FROM calls JOIN cid USING (call_seq)
  WINDOW w AS (PARTITION BY cluster_id ORDER BY pos_a, pos_b, call_seq)),
rep AS (SELECT cluster_id, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, sv_type FROM member WHERE place = n_members // 2 + 1),
agg AS (SELECT cluster_id, min(sample) AS sample, min(call_seq) AS first_seq, list_sort(list(DISTINCT caller)) AS callers_supporting, CAST(count(DISTINCT caller) AS BIGINT) AS n_callers,
  greatest(0, max(split_reads)) AS split_reads, greatest(0, max(discordant_pairs)) AS discordant_pairs, greatest(0, max(assembly_contigs)) AS assembly_contigs,
  greatest(0, max(soft_clips)) AS soft_clips, max(vaf) AS vaf, max(raw_qual) AS raw_qual_max, bool_or(precise) AS precise, bool_or(filter_pass) AS any_pass,
  list(record_id ORDER BY pos_a, pos_b, call_seq) AS member_record_ids FROM member GROUP BY cluster_id),
clu AS (SELECT *, CAST((split_reads > 0)::INT + (discordant_pairs > 0)::INT + (assembly_contigs > 0)::INT + (soft_clips > 0)::INT AS BIGINT) AS n_evidence_types
  FROM agg JOIN rep USING (cluster_id))"""
)

CALLED = (
    CLUSTERS
    + """,
rule AS (SELECT *, n_callers = 1 AND NOT precise AS loose, n_callers >= 2 AND any_pass AND split_reads >= 3 AND n_evidence_types >= 2 AND precise AS several,
  n_callers = 1 AND any_pass AND precise AND split_reads >= 10 AND discordant_pairs >= 10 AND n_evidence_types >= 2 AS strongest,
  n_callers = 1 AND any_pass AND split_reads >= 5 AND assembly_contigs >= 1 AS strong, n_callers = 1 AND any_pass AND split_reads >= 5 AS medium FROM clu),
called AS (SELECT * EXCLUDE (loose, several, strongest, strong, medium),
  CASE WHEN several OR strongest THEN 'T1' WHEN n_callers >= 2 OR strong OR medium THEN 'T2' ELSE 'T3' END AS tier,
  list_filter([CASE WHEN loose THEN 'singleton_imprecise' END, CASE WHEN raw_qual_max < 0 THEN 'low_quality' END,
    CASE WHEN several THEN NULL WHEN strongest THEN 'single_caller_very_strong' WHEN n_callers >= 2 THEN NULL WHEN strong THEN 'single_caller_strong'
         WHEN medium THEN 'single_caller_medium' END], lambda x: x IS NOT NULL) AS qc_flags,
  format('{}__{}_{}_{}__{}_{}_{}__{:05d}', sample, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, row_number() OVER (PARTITION BY sample ORDER BY first_seq) - 1) AS fusion_id
  FROM rule)"""
)


def _locus(side: str) -> str:
    return f"""
hit_{side} AS (SELECT cluster_id, gene AS gene_{side}, role AS role_{side} FROM (SELECT cluster_id, gene, role, row_number() OVER (PARTITION BY cluster_id ORDER BY start, ord) AS k
  FROM called JOIN loci ON chrom = chrom_{side} AND pos_{side} BETWEEN start - 5000 AND stop + 5000) WHERE k = 1)"""


def _region(side: str) -> str:
    return f"""
region_{side} AS (SELECT cluster_id, CASE WHEN pos_{side} BETWEEN start AND stop THEN 'exonic_or_intronic' WHEN pos_{side} < start THEN 'upstream' ELSE 'downstream' END AS region_{side}
  FROM called JOIN loci ON chrom = chrom_{side} AND pos_{side} BETWEEN start - 5000 AND stop + 5000
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY start, ord) = 1)"""


ANNOTATED = (
    CALLED
    + f""",
loci AS ({for_duckdb("loci")}), partners AS ({for_duckdb("partners")}), artefacts AS ({for_duckdb("artefacts")}),{_locus("a")},{_locus("b")},
pairs AS (SELECT least(partner_a, partner_b) AS x, greatest(partner_a, partner_b) AS y, arg_min(trim(concat(source, ':', disease), ':'), ord) AS kp_source FROM partners GROUP BY 1, 2),
named AS (SELECT called.*, coalesce(gene_a, '') AS gene_a, coalesce(gene_b, '') AS gene_b, role_a, role_b FROM called LEFT JOIN hit_a USING (cluster_id) LEFT JOIN hit_b USING (cluster_id)),
annotated AS (SELECT named.*, kp_source IS NOT NULL AS known_partner, coalesce(kp_source, '') AS known_partner_source,
  concat_ws('-', CASE WHEN role_a IN ('driver', 'IG_locus') THEN gene_a END, CASE WHEN role_b IN ('driver', 'IG_locus') THEN gene_b END) AS driver_locus
  FROM named LEFT JOIN pairs ON gene_a <> '' AND gene_b <> '' AND x = least(gene_a, gene_b) AND y = greatest(gene_a, gene_b)),
q0 AS (SELECT * REPLACE (CASE WHEN first_seq % 11 = 0 THEN concat('GL000', first_seq % 9, '.1') WHEN first_seq % 7 = 0 THEN chrom_a ELSE chrom_b END AS chrom_b,
  CASE WHEN first_seq % 11 <> 0 AND first_seq % 7 = 0 THEN pos_a + first_seq % 400 ELSE pos_b END AS pos_b) FROM annotated)"""
)


def _flagged(name: str, source: str, when: str, flag: str, tier: str = "tier") -> str:
    return f"""
{name} AS (SELECT * REPLACE (CASE WHEN {when} THEN {tier} ELSE tier END AS tier,
  CASE WHEN ({when}) AND NOT list_contains(qc_flags, '{flag}') THEN list_append(qc_flags, '{flag}') ELSE qc_flags END AS qc_flags) FROM {source})"""


def _masked(name: str, source: str) -> str:
    hit = f"SELECT DISTINCT cluster_id FROM {source} JOIN artefacts ON (chrom = chrom_a AND pos_a BETWEEN start AND stop) OR (chrom = chrom_b AND pos_b BETWEEN start AND stop)"
    return _flagged(name, source, f"cluster_id IN ({hit})", "builtin_artefact_locus", "'T3'")


def _recurrent(name: str, source: str, partners: int, chroms: int, tier: str) -> str:
    return f"""
{name}_cells AS (SELECT chrom_a AS chrom, pos_a // 500 AS cell, chrom_b AS chrom2, pos_b // 500 AS cell2 FROM {source}
  UNION SELECT chrom_b, pos_b // 500, chrom_a, pos_a // 500 FROM {source}),
{name}_hot AS (SELECT chrom, cell FROM {name}_cells GROUP BY 1, 2 HAVING count(*) >= {partners} AND count(DISTINCT chrom2) >= {chroms}),""" + _flagged(
        name, source, f"(chrom_a, pos_a // 500) IN (SELECT (chrom, cell) FROM {name}_hot) OR (chrom_b, pos_b // 500) IN (SELECT (chrom, cell) FROM {name}_hot)", "recurrent_artefact", tier
    )


_EXEMPT = ", ".join(f"'{g}'" for g in SHORT_RANGE_EXEMPT)
_PHYS = "event_class IN ('IG_intra', 'IG_IG', 'driver_intra')"
_DECOY = "'(?i)(_decoy|_random|_alt|^chrUn|^Un_|KI270|GL000|JTFH|KN707|HLA-|EBV)'"


def _short(name: str, source: str) -> str:
    return _flagged(name, source, f"chrom_a = chrom_b AND abs(pos_b - pos_a) < 200 AND gene_a NOT IN ({_EXEMPT}) AND gene_b NOT IN ({_EXEMPT})", "short_range")


def _undetermined(name: str, source: str) -> str:
    return _flagged(name, source, "list_contains(qc_flags, 'builtin_artefact_locus')", "partner_undetermined", "'T3'")


def _promoted(name: str, source: str) -> str:
    goal = "CASE WHEN split_reads >= 5 OR discordant_pairs >= 10 THEN 'T1' ELSE 'T2' END"
    return _flagged(name, source, f"known_partner AND split_reads + discordant_pairs >= 5 AND {goal} < tier", "promoted_known_partner", goal)


def _classed(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT *, CASE WHEN ia AND ib THEN CASE WHEN gene_a = gene_b THEN 'IG_intra' ELSE 'IG_IG' END
  WHEN ia OR ib THEN CASE WHEN (ia AND db) OR (ib AND da) THEN CASE WHEN known_partner THEN 'IG_driver_canonical' ELSE 'IG_driver_novel' END ELSE 'IG_intergenic' END
  WHEN da AND db THEN CASE WHEN gene_a = gene_b THEN 'driver_intra' ELSE 'driver_driver' END WHEN da OR db THEN 'driver_intergenic' ELSE 'intergenic' END AS event_class
  FROM (SELECT *, coalesce(role_a = 'IG_locus', false) AS ia, coalesce(role_b = 'IG_locus', false) AS ib, coalesce(role_a = 'driver', false) AS da,
    coalesce(role_b = 'driver', false) AS db FROM {source}))"""


def _nonclinical(name: str, source: str) -> str:
    return _flagged(name, source, f"tier = 'T1' AND NOT known_partner AND NOT (n_callers >= 2 AND any_pass) AND ({_PHYS} OR list_contains(qc_flags, 'recurrent_artefact'))", "demoted_nonclinical_t1", "'T3'")


def _decoyed(name: str, source: str) -> str:
    when = f"tier <> 'T3' AND NOT (known_partner AND gene_a <> '' AND gene_b <> '') AND (regexp_matches(chrom_a, {_DECOY}) OR regexp_matches(chrom_b, {_DECOY}))"
    return _flagged(name, source, when, "decoy_partner", "'T3'")


def _noise(name: str, source: str) -> str:
    when = f"""tier IN ('T1', 'T2') AND NOT known_partner AND event_class NOT IN ('IG_driver_canonical', 'IG_driver_novel', 'driver_driver', 'driver_intergenic')
      AND ({_PHYS} OR (list_contains(qc_flags, 'recurrent_artefact') AND event_class IN ('IG_intergenic', 'intergenic')))"""
    return _flagged(name, source, when, "demoted_review_noise", "'T3'")


def _unpaired(name: str, source: str) -> str:
    return _flagged(name, source, "tier IN ('T1', 'T2') AND chrom_a <> chrom_b AND discordant_pairs < 1 AND assembly_contigs = 0", "no_discordant_support", "'T3'")


def _gated(name: str, source: str) -> str:
    when = "tier = 'T1' AND NOT (gene_a <> '' AND gene_b <> '' AND gene_a <> gene_b AND known_partner) AND n_callers < 2"
    return _flagged(name, source, when, "t1_capped_unresolved", "'T2'")


FINAL = ",".join(
    [
        ANNOTATED, _masked("q1", "q0"), _recurrent("q2", "q1", 10, 3, "tier"), _short("q3", "q2"), _undetermined("q4", "q3"), _promoted("q5", "q4"), _classed("q6", "q5"),
        _nonclinical("q7", "q6"), _decoyed("q8", "q7"), _noise("q9", "q8"), _unpaired("q10", "q9"), _gated("fin", "q10"),
    ]
)

_OUT = "SELECT fusion_id, tier, array_to_string(qc_flags, ',') AS qc_flags FROM "


def _one(step: str, name: str = "out") -> str:
    return f"WITH RECURSIVE {ANNOTATED},{step} {_OUT}{name}"


def _fin(select: str) -> str:
    return f"WITH RECURSIVE {FINAL} {select}"


_TOP = "tier IN ('T1', 'T2')"
_COUNTS = f"""CAST(count(*) FILTER (tier = 'T1') AS BIGINT) AS t1, CAST(count(*) FILTER (tier = 'T2') AS BIGINT) AS t2, CAST(count(*) FILTER (tier = 'T3') AS BIGINT) AS t3,
  CAST(count(*) FILTER (event_class IN ('IG_driver_canonical', 'driver_driver') AND {_TOP}) AS BIGINT) AS somatic,
  CAST(count(*) FILTER (event_class IN ('IG_driver_novel', 'driver_intergenic') AND {_TOP}) AS BIGINT) AS novel,
  CAST(count(*) FILTER (event_class IN ('IG_intra', 'IG_IG')) AS BIGINT) AS physio"""
_LLR = """greatest(0.0, least(split_reads, 30) * 4.0 + least(discordant_pairs, 30) * 1.8 + CASE WHEN assembly_contigs > 0 THEN 20 ELSE 0 END
  + CASE WHEN n_callers >= 2 THEN (n_callers - 1) * 10 ELSE 0 END + CASE WHEN known_partner THEN 30 ELSE 0 END + CASE WHEN precise THEN 10 ELSE 0 END
  + CASE WHEN any_pass THEN 5 ELSE 0 END + CASE WHEN event_class IN ('IG_intra', 'IG_IG') THEN -40 WHEN event_class = 'driver_intra' THEN -25 ELSE 0 END
  + CASE WHEN list_contains(qc_flags, 'recurrent_artefact') THEN -60 ELSE 0 END)"""
_CELL = "chrom_a, pos_a // {w} AS cell_a, chrom_b, pos_b // {w} AS cell_b"
_CLS = """cls AS (SELECT least(partner_a, partner_b) AS x, greatest(partner_a, partner_b) AS y, concat('t_', source) AS class, disease AS label FROM partners WHERE source <> 'later'),
tr AS (SELECT fin.*, class, label FROM fin JOIN cls ON x = least(gene_a, gene_b) AND y = greatest(gene_a, gene_b))"""


def _pair(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_filter([coalesce({a}, ''), coalesce({b}, '')], lambda g: g NOT IN ('', '-'))))"


def _scored(match: str, fp: str, scanned: bool) -> str:
    only = "WHERE sample_id IN (SELECT sample FROM fin)" if scanned else ""
    return f"""
tru AS (SELECT sample_id AS sample, truth_class, {_pair("gene_a", "gene_b")} AS e FROM ({for_duckdb("truth")}) {only}),
smp AS (SELECT sample, CAST(count(*) FILTER (truth_class = 'disputed') AS BIGINT) AS disputed_rows, bool_and(truth_class IN ('none_expected', 'disputed')) AS negative_control FROM tru
  GROUP BY sample HAVING bool_or(truth_class = 'none_expected' OR (truth_class IN ('confirmed', 'likely', 'driver_focal') AND len(e) > 0))),
pos AS (SELECT row_number() OVER () AS k, sample, e FROM tru SEMI JOIN smp USING (sample) WHERE truth_class IN ('confirmed', 'likely', 'driver_focal') AND len(e) > 0),
cal AS (SELECT sample, tier, {_pair("gene_a", "gene_b")} AS c, fusion_id FROM fin),
hit AS (SELECT k, min(tier) AS best FROM pos JOIN cal ON cal.sample = pos.sample AND {match} WHERE tier IN ('T1', 'T2') AND len(c) > 0 GROUP BY k),
jun AS (SELECT DISTINCT sample, {_pair("gene_a", "gene_b")} AS e FROM ({for_duckdb("junctions")}) WHERE sr_junction >= 2 OR pe_junction >= 2),
good AS (SELECT pos.sample, count(best) AS tp, count(*) - count(best) AS fn, count(best) FILTER (jun.sample IS NOT NULL) AS tp_detected, count(best) FILTER (jun.sample IS NULL) AS tp_lookup
  FROM pos LEFT JOIN hit USING (k) LEFT JOIN jun ON jun.sample = pos.sample AND jun.e = pos.e GROUP BY pos.sample),
wrong AS (SELECT cal.sample, c, EXISTS (SELECT 1 FROM tru WHERE tru.sample = cal.sample AND truth_class = 'disputed' AND len(e) > 0 AND {match}) AS doubtful FROM cal
  WHERE cal.sample IN (SELECT sample FROM smp) AND len(c) > 0 AND tier IN ({fp}) AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.sample = cal.sample AND {match})),
bad AS (SELECT sample, count(*) FILTER (NOT doubtful) AS fp, count(*) FILTER (doubtful) AS exempt FROM wrong GROUP BY sample),
t1s AS (SELECT sample, count(*) AS t1_calls FROM cal WHERE tier = 'T1' GROUP BY sample),
sco AS (SELECT sample, negative_control, disputed_rows, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fn, 0) AS BIGINT) AS fn, CAST(coalesce(fp, 0) AS BIGINT) AS fp,
  CAST(coalesce(exempt, 0) AS BIGINT) AS exempt, CAST(coalesce(t1_calls, 0) AS BIGINT) AS t1_calls, CAST(coalesce(tp_detected, 0) AS BIGINT) AS tp_detected, CAST(coalesce(tp_lookup, 0) AS BIGINT) AS tp_lookup
  FROM smp LEFT JOIN good USING (sample) LEFT JOIN bad USING (sample) LEFT JOIN t1s USING (sample))"""


_IG, _DRV = "list_filter({0}, lambda g: g[1] = 'G')", "list_filter({0}, lambda g: g[1] <> 'G')"
_LAX = f"""(c = e OR (len({_DRV.format("c")}) > 0 AND {_DRV.format("c")} = {_DRV.format("e")} AND len({_IG.format("c")}) > 0 AND len({_IG.format("e")}) > 0)
  OR (len({_DRV.format("e")}) > 0 AND {_DRV.format("c")} = {_DRV.format("e")} AND len({_IG.format("c")}) = 0 AND len(c) = 1))"""

READS = f"reads AS ({for_duckdb('reads')}), windows AS ({for_duckdb('windows')})"
_LEAD, _TRAIL = "coalesce(try_cast(nullif(regexp_extract(cigar, '^(\\d+)[{k}]', 1), '') AS INT), 0)", "coalesce(try_cast(nullif(regexp_extract(cigar, '(\\d+)[{k}]$', 1), '') AS INT), 0)"


def _noisy(x: str) -> str:
    return f"""({x} <> '' AND (contains({x}, 'AGATCGGAAGA') OR contains({x}, 'GCTCTTCCGAT') OR (length({x}) - length(replace({x}, 'G', ''))) / greatest(length({x}), 1) >= 0.7
  OR (length({x}) - length(replace({x}, 'C', ''))) / greatest(length({x}), 1) >= 0.7))"""


CLIPS = f"""{READS},
c0 AS (SELECT *, {_LEAD.format(k="SH")} AS la, {_TRAIL.format(k="SH")} AS tr, {_LEAD.format(k="S")} AS ls, {_TRAIL.format(k="S")} AS ts FROM reads),
c1 AS (SELECT *, CASE WHEN la = 0 AND tr = 0 THEN '.' WHEN la >= tr THEN 'L' ELSE 'R' END AS side,
  CASE WHEN ls = 0 AND ts = 0 THEN '' WHEN ls >= ts THEN seq[1:ls] ELSE right(seq, ts) END AS clip, substr(seq, ls + 1, length(seq) - ls - ts) AS aligned,
  regexp_matches(cigar, '\\d+H') AS hard FROM c0),
c2 AS (SELECT *, CASE WHEN clip <> '' THEN {_noisy("clip")} WHEN hard THEN {_noisy("aligned")} ELSE false END AS noise FROM c1)"""
NEAR = f"""{CLIPS},
n0 AS (SELECT c2.*, gene, windows.start AS w_start, stop AS w_stop FROM c2 JOIN windows ON contig = chrom AND ref_start < stop AND ref_end > windows.start),
n1 AS (SELECT * FROM n0 WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 1024 = 0 AND mapq >= 20)"""
_W = "least(1.0, greatest(0.0, CAST(mapq AS DOUBLE) / 30))"


def _supports(source: str, order: str = "k") -> str:
    return f"""
s0 AS (SELECT *, unnest(range(len(parts))) AS k, unnest(parts) AS p FROM (SELECT *, list_filter(list_transform(list_filter(string_split(sa, ';'), lambda x: x <> ''), lambda x: string_split(x, ',')),
  lambda p: len(p) >= 4 AND regexp_full_match(p[2], '-?\\d+')) AS parts FROM {source} WHERE NOT noise)),
s1 AS (SELECT sample, gene, read_id, contig AS chrom_a, CASE WHEN side = 'L' THEN ref_start ELSE ref_end END AS pos_a, CASE side WHEN 'L' THEN '-' WHEN 'R' THEN '+' ELSE '.' END AS strand_a, mapq, {_W} AS w, k,
  p[1] AS chrom_b, CAST(p[2] AS BIGINT) AS pos_b, CAST(p[2] AS BIGINT) // 500 AS cell, {_LEAD.format(k="SH").replace("cigar", "p[4]")} AS la2, {_TRAIL.format(k="SH").replace("cigar", "p[4]")} AS tr2, w_start, w_stop FROM s0),
s2 AS (SELECT *, CASE WHEN la2 = 0 AND tr2 = 0 THEN '.' WHEN la2 >= tr2 THEN '-' ELSE '+' END AS strand_b FROM s1),
sup AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY sample, gene, read_id, chrom_a, chrom_b, cell, strand_a, strand_b ORDER BY {order}) = 1)"""


def _gather(name: str, source: str, weight: str = "sum(w)", first: str = "read_id") -> str:
    return f"""
{name} AS (SELECT sample, gene, chrom_a, chrom_b, cell, strand_a, strand_b, {weight} AS weight, list_sort(list(pos_a))[count(*) // 2 + 1] AS pos_a, arg_min(pos_b, {first}) AS pos_b, count(*) AS n_reads,
  CAST(floor(avg(mapq)) AS BIGINT) AS mapq FROM {source} GROUP BY ALL)"""


_DIS = f"""
dis AS (SELECT sample, gene, read_id, contig AS chrom_a, mate_contig AS chrom_b, mate_start // 500 AS cell, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand_a,
  CASE WHEN flag & 32 <> 0 THEN '-' ELSE '+' END AS strand_b, ref_end AS pos_a, mate_start AS pos_b, mapq, {_W} AS w FROM n1
  WHERE flag & 1 <> 0 AND flag & 8 = 0 AND (mate_contig <> contig OR abs(mate_start - ref_end) >= 10000)
  AND NOT EXISTS (SELECT 1 FROM sup WHERE sup.sample = n1.sample AND sup.gene = n1.gene AND sup.read_id = n1.read_id))"""
SCAN = f"{NEAR},{_supports('n1')},{_gather('spl', 'sup')},{_DIS},{_gather('dcl', 'dis')}"
#: The same with weights as whole thirtieths, whose sum is the same in any order of reads (a sum of floats isn't, and was rounded
#: by chance where it should be half-way), and with an order of rows that share a read's name.
_TIES, _THIRTIETHS = "k, pos_a, pos_b, mapq", "sum(least(30, greatest(0, mapq))) / 30"
EXACT_SCAN = f"{NEAR},{_supports('n1', _TIES)},{_gather('spl', 'sup', _THIRTIETHS, '(read_id, pos_b)')},{_DIS},{_gather('dcl', 'dis', _THIRTIETHS, '(read_id, pos_b)')}"
_ROUND_EVEN = "CASE WHEN weight - floor(weight) = 0.5 THEN 2 * round(weight / 2) ELSE round(weight) END"
_CLUSTER_OUT = "SELECT sample, gene, chrom_a, chrom_b, cell, strand_a, strand_b, round(weight, 6) AS weight, pos_a, pos_b, n_reads, mapq FROM "

_ESC = "replace(replace(replace(replace(replace({0}, '%', '%25'), ';', '%3B'), '=', '%3D'), ',', '%2C'), ' ', '%20')"
_INFO = """concat_ws(';', concat('SVTYPE=', sv_type), CASE WHEN mate <> '' THEN concat('MATEID=', mate) END, CASE WHEN NOT is_bnd THEN concat('END=', pos_b) END,
  CASE WHEN NOT is_bnd THEN concat('SVLEN=', CASE WHEN sv_type = 'DEL' THEN -abs(pos_b - pos_a) ELSE abs(pos_b - pos_a) END) END, CASE WHEN NOT precise THEN 'IMPRECISE' END,
  concat('FF_TIER=', tier), concat('FF_EVENT_CLASS=', event_class), CASE WHEN near <> '' THEN concat('FF_GENE_A=', near) END, CASE WHEN far <> '' THEN concat('FF_GENE_B=', far) END,
  CASE WHEN driver_locus <> '' THEN concat('FF_DRIVER_LOCUS=', driver_locus) END, concat('FF_KNOWN_PARTNER=', known_partner::INT),
  CASE WHEN known_partner_source <> '' THEN concat('FF_KP_SOURCE=', known_partner_source) END, concat('FF_N_CALLERS=', n_callers), concat('FF_CALLERS=', array_to_string(callers_supporting, '|')),
  concat('FF_N_EV_TYPES=', n_evidence_types), concat('FF_SR=', split_reads), concat('FF_PE=', discordant_pairs), concat('FF_ASM=', assembly_contigs), concat('FF_SC=', soft_clips),
  concat('FF_VAF=', CASE WHEN vaf <> 0 THEN format('{:.4f}', vaf) ELSE '0.0' END), concat('FF_PRECISE=', precise::INT), concat('FF_ANY_PASS=', any_pass::INT),
  CASE WHEN len(qc_flags) > 0 THEN concat('FF_QC_FLAGS=', array_to_string(qc_flags, '|')) END, concat('FF_FUSION_ID=', fusion_id))"""
VCF = f"""{FINAL},
v0 AS (SELECT *, sv_type = 'BND' OR chrom_a <> chrom_b AS is_bnd, concat('chr', chrom_a) AS ca, concat('chr', chrom_b) AS cb FROM fin),
v1 AS (SELECT *, ca AS chrom, greatest(1, pos_a) AS pos, CASE WHEN is_bnd THEN concat(fusion_id, '.1') ELSE fusion_id END AS id, CASE WHEN is_bnd THEN concat(fusion_id, '.2') ELSE '' END AS mate,
    gene_a AS near, gene_b AS far, strand_a AS s1, strand_b AS s2, concat(cb, ':', greatest(1, pos_b)) AS to_place FROM v0
  UNION ALL SELECT *, cb, greatest(1, pos_b), concat(fusion_id, '.2'), concat(fusion_id, '.1'), gene_b, gene_a, CASE WHEN strand_a = strand_b THEN CASE strand_a WHEN '+' THEN '-' ELSE '+' END ELSE strand_a END,
    CASE WHEN strand_a = strand_b THEN CASE strand_a WHEN '+' THEN '-' ELSE '+' END ELSE strand_b END, concat(ca, ':', greatest(1, pos_a)) FROM v0 WHERE is_bnd),
rec AS (SELECT *, CASE WHEN NOT is_bnd THEN concat('<', sv_type, '>') WHEN s1 = '+' AND s2 = '-' THEN concat('N]', to_place, ']') WHEN s1 = '-' AND s2 = '+' THEN concat('[', to_place, '[N')
    WHEN s1 = '-' THEN concat(']', to_place, ']N') ELSE concat('N[', to_place, '[') END AS alt, CASE WHEN raw_qual_max <> 0 THEN format('{{:.1f}}', raw_qual_max) ELSE '.' END AS qual,
  CASE WHEN NOT any_pass AND n_callers <= 1 AND tier = 'T3' THEN 'LowQual;T3' WHEN NOT any_pass AND n_callers <= 1 THEN 'LowQual' WHEN tier = 'T3' THEN 'T3' ELSE 'PASS' END AS filter,
  concat('./.:', split_reads, ':', discordant_pairs, ':.,', split_reads + discordant_pairs, ':', split_reads + discordant_pairs) AS sample_value, {_INFO} AS info FROM v1)"""


def _vcf(select: str) -> str:
    return f"WITH RECURSIVE {VCF} {select}"


_RATIO = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"""
_LINEAGE = """CASE WHEN upper(trim(cohort)) IN ('PMBL', 'DLBCL', 'FL') THEN 'B' WHEN upper(trim(cohort)) IN ('ATLL', 'PTCL', 'T-CELL NHL') THEN 'T' ELSE 'any' END AS lineage"""

def _artefacts(more: str = "", order: str = "k") -> str:
    return f"""WITH {CLIPS}, n0 AS (SELECT c2.*, gene, windows.start AS w_start, stop AS w_stop FROM c2 JOIN windows ON contig = chrom AND ref_start < stop + 200 AND ref_end > windows.start - 200),
      n1 AS (SELECT * FROM n0 WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 1024 = 0 AND mapq >= 20 AND NOT {_noisy("aligned")}),{_supports("n1", order)}
      SELECT sample, gene, chrom_a, chrom_b, cell, strand_a, strand_b, {more} count(*) AS n, list(pos_a ORDER BY read_id)[count(*) // 2 + 1] AS pos_a, arg_min(pos_b, read_id) AS pos_b
      FROM sup WHERE chrom_b <> chrom_a OR pos_b < w_start - 1000 OR pos_b > w_stop + 1000 GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(*) >= 2"""

ORACLES: dict[str, str] = {
    "provisional_tier": f"WITH RECURSIVE {CALLED} SELECT cluster_id, fusion_id, tier, array_to_string(qc_flags, ',') AS qc_flags FROM called",
    "breakpoint_order": f"WITH {CALLS} SELECT call_seq, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b FROM calls",
    "neighbour_pairs": f"WITH RECURSIVE {CALLS}{_components(True)} SELECT a, b FROM edge WHERE a < b",
    "components": f"WITH RECURSIVE {CALLS}{_components(True)} SELECT call_seq, cluster_id FROM cid",
    "components_unstranded": f"WITH RECURSIVE {CALLS}{_components(False)} SELECT call_seq, cluster_id FROM cid",
    "components_min_samples": f"WITH RECURSIVE {CALLS}{_components(True)} SELECT call_seq, cluster_id FROM cid QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 2",
    "cluster_representative": f"""WITH RECURSIVE {CLUSTERS} SELECT cluster_id, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, array_to_string(callers_supporting, ',') AS callers_supporting,
      array_to_string(member_record_ids, ',') AS member_record_ids FROM clu""",
    "evidence_summary": f"""WITH RECURSIVE {CLUSTERS} SELECT cluster_id, n_callers, n_evidence_types, split_reads, discordant_pairs, assembly_contigs, soft_clips, vaf, raw_qual_max, precise, any_pass
      FROM clu""",
    "gene_annotation": f"WITH RECURSIVE {ANNOTATED} SELECT cluster_id, gene_a, gene_b, driver_locus FROM annotated",
    "region_annotation": f"""WITH RECURSIVE {ANNOTATED}, {_region("a")}, {_region("b")} SELECT cluster_id, coalesce(region_a, 'intergenic') AS region_a, coalesce(region_b, 'intergenic') AS region_b
      FROM called LEFT JOIN region_a USING (cluster_id) LEFT JOIN region_b USING (cluster_id)""",
    "novel_top": _fin(f"""SELECT fusion_id, tier, event_class FROM fin WHERE event_class IN ('IG_driver_novel', 'driver_intergenic') AND {_TOP}
      ORDER BY tier, split_reads + discordant_pairs DESC, first_seq LIMIT 60"""),
    "between_receptors": _fin("SELECT fusion_id, gene_a, gene_b FROM fin WHERE event_class IN ('IG_IG', 'driver_intra') ORDER BY first_seq LIMIT 200"),
    "receptor_counts": _fin("SELECT CASE WHEN gene_a <> '' THEN gene_a ELSE gene_b END AS gene, count(*) AS n FROM fin WHERE event_class = 'IG_intra' GROUP BY 1"),
    "best_per_pair": _fin(f""", {_CLS} SELECT least(gene_a, gene_b) AS gene_1, greatest(gene_a, gene_b) AS gene_2, fusion_id, tier FROM tr
      QUALIFY row_number() OVER (PARTITION BY least(gene_a, gene_b), greatest(gene_a, gene_b) ORDER BY tier, split_reads + discordant_pairs DESC, first_seq) = 1"""),
    "arc_points": f"""WITH a AS (SELECT sample_id, length(cell_line) * 0.1::DOUBLE AS t1, length(cell_line) * 0.35::DOUBLE + 1 AS t2, unnest(range(0, 51)) AS step FROM ({for_duckdb('metadata')})),
      b AS (SELECT sample_id, CAST(step AS INT) AS step, cos(t1) AS x1, sin(t1) AS y1, cos(t2) AS x2, sin(t2) AS y2, step / 50.0::DOUBLE AS t FROM a),
      c AS (SELECT sample_id, step, (1 - t) ** 2 * x1 + 2 * (1 - t) * t * (x1 + x2) * 0.15 + t ** 2 * x2 AS x, (1 - t) ** 2 * y1 + 2 * (1 - t) * t * (y1 + y2) * 0.15 + t ** 2 * y2 AS y FROM b)
      SELECT sample_id, step, round(CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 6) AS theta, round(sqrt(x * x + y * y), 6) AS r FROM c""",
    "known_partner": f"WITH RECURSIVE {ANNOTATED} SELECT cluster_id, known_partner, known_partner_source FROM annotated",
    "qc_artefact": _one(_masked("out", "q0")),
    "qc_recurrent": _one(_recurrent("out", "q0", 3, 1, "CASE tier WHEN 'T1' THEN 'T2' WHEN 'T2' THEN 'T3' ELSE tier END")),
    "qc_short_range": _one(_short("out", "q0")),
    "qc_masked": _one(",".join([_masked("q1", "q0"), _recurrent("q2", "q1", 10, 3, "tier"), _short("q3", "q2"), _undetermined("out", "q3")])),
    "qc_promote": _one(_promoted("out", "q0")),
    "event_class": f"WITH RECURSIVE {ANNOTATED},{_classed('out', 'q0')} SELECT fusion_id, event_class FROM out",
    "qc_demote_t1": _one(_classed("q6", "q0") + "," + _nonclinical("out", "q6")),
    "qc_decoy": _one(_decoyed("out", "q0")),
    "qc_physiological": _one(_classed("q6", "q0") + "," + _noise("out", "q6")),
    "qc_discordant": _one(_unpaired("out", "q0")),
    "qc_gate": _one(_gated("out", "q0")),
    "qc_full": _fin("SELECT fusion_id, tier, event_class, array_to_string(qc_flags, ',') AS qc_flags FROM fin"),
    "llr_score": _fin(f"SELECT fusion_id, round(CAST({_LLR} AS DOUBLE), 6) AS llr FROM fin"),
    "llr_promote": _fin(f"""SELECT fusion_id, CASE WHEN goal < tier THEN goal ELSE tier END AS tier, array_to_string(CASE WHEN goal < tier AND NOT list_contains(qc_flags, concat('llr_promoted_', goal, '_from_', tier))
      THEN list_append(qc_flags, concat('llr_promoted_', goal, '_from_', tier)) ELSE qc_flags END, ',') AS qc_flags
      FROM (SELECT *, CASE WHEN s >= 100 THEN 'T1' WHEN s >= 50 THEN 'T2' ELSE 'T3' END AS goal FROM (SELECT *, CAST({_LLR} AS DOUBLE) AS s FROM fin))"""),
    "cohort_recurrence": _fin(f"SELECT {_CELL.format(w=1000)}, count(DISTINCT sample) AS n_samples FROM fin GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT sample) > 1"),
    "recurrence_top": _fin(f""", cells AS (SELECT *, {_CELL.format(w=1000).replace("chrom_a, ", "").replace("chrom_b, ", "")} FROM fin),
      g AS (SELECT chrom_a, cell_a, chrom_b, cell_b, count(DISTINCT sample) AS n_samples, min(tier) AS best_tier, min(first_seq) AS seen,
        arg_max(struct_pack(f := fusion_id, d := driver_locus, k := known_partner), (n_callers, -first_seq)) AS e FROM cells GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT sample) > 1)
      SELECT chrom_a, cell_a, chrom_b, cell_b, n_samples, e.f AS fusion_id, e.d AS driver_locus, e.k AS known_partner, best_tier FROM g ORDER BY n_samples DESC, seen LIMIT 50"""),
    "per_sample_summary": _fin(f"""SELECT sample, {_COUNTS}, coalesce(string_agg(concat(gene_a, '-', gene_b, '|', tier), '; ' ORDER BY first_seq) FILTER (event_class = 'IG_driver_canonical' AND {_TOP}), '')
      AS canonical_partners FROM fin GROUP BY sample"""),
    "kpis": _fin(f"SELECT {_COUNTS}, count(DISTINCT sample) AS samples, (SELECT count(DISTINCT c) FROM (SELECT unnest(callers_supporting) AS c FROM fin)) AS callers_run FROM fin"),
    "caller_tier_pivot": _fin("""SELECT caller, count(*) FILTER (tier = 'T1') AS t1, count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3
      FROM (SELECT unnest(callers_supporting) AS caller, tier FROM fin) GROUP BY caller"""),
    "qc_histograms": _fin("""SELECT 'tier' AS kind, tier AS value, count(*) AS n FROM fin GROUP BY tier UNION ALL
      SELECT 'n_callers', CAST(k AS VARCHAR), (SELECT count(*) FROM fin WHERE n_callers = k) FROM (SELECT unnest(range(1, (SELECT max(n_callers) FROM fin) + 1)) AS k) UNION ALL
      SELECT 'flag', f, count(*) FROM (SELECT unnest(qc_flags) AS f FROM fin) GROUP BY f"""),
    "evidence_hist": _fin(""", l AS (SELECT 'split_reads' AS evidence, split_reads AS v FROM fin WHERE split_reads > 0 UNION ALL SELECT 'discordant_pairs', discordant_pairs FROM fin WHERE discordant_pairs > 0)
      SELECT evidence, CAST(floor((v - low) * 40 / (high - low + 1)) AS BIGINT) AS bin, count(*) AS n
      FROM (SELECT *, min(v) OVER (PARTITION BY evidence) AS low, max(v) OVER (PARTITION BY evidence) AS high FROM l) GROUP BY 1, 2"""),
    "locus_summary": _fin("""SELECT gene, count(*) FILTER (tier = 'T1') AS t1, count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3, count(*) FILTER (known_partner) AS known_partner
      FROM (SELECT DISTINCT gene, cluster_id, tier, known_partner FROM fin JOIN loci ON (chrom = chrom_a AND pos_a BETWEEN start - 50000 AND stop + 50000)
        OR (chrom = chrom_b AND pos_b BETWEEN start - 50000 AND stop + 50000)) GROUP BY gene"""),
    "physio_top": _fin("""SELECT CASE WHEN gene_a = gene_b THEN concat(gene_a, ' (intra)') ELSE concat(gene_a, ' - ', gene_b) END AS locus, count(*) AS n FROM fin
      WHERE event_class IN ('IG_intra', 'IG_IG') GROUP BY 1 ORDER BY n DESC, locus LIMIT 15"""),
    "translocation_groups": _fin(f", {_CLS} SELECT class, label, tier, count(*) AS n FROM tr GROUP BY 1, 2, 3"),
    "best_per_sample": _fin(f""", {_CLS} SELECT class, sample, fusion_id, tier FROM tr
      QUALIFY row_number() OVER (PARTITION BY class, sample ORDER BY tier, split_reads + discordant_pairs DESC, first_seq) = 1"""),
    "caller_jaccard": _fin(f""", u AS (SELECT DISTINCT unnest(callers_supporting) AS caller, {_CELL.format(w=500)}, strand_a, strand_b FROM fin), n AS (SELECT caller, count(*) AS n FROM u GROUP BY caller)
      SELECT x.caller AS caller_1, y.caller AS caller_2, coalesce(s, 0) AS shared, round(coalesce(s, 0) / (x.n + y.n - coalesce(s, 0)), 6) AS jaccard FROM n x CROSS JOIN n y
      LEFT JOIN (SELECT p.caller AS a, q.caller AS b, count(*) AS s FROM u p JOIN u q USING (chrom_a, cell_a, chrom_b, cell_b, strand_a, strand_b) GROUP BY 1, 2) ON a = x.caller AND b = y.caller"""),
    "replicate_overlap": _fin(f""", m AS (SELECT DISTINCT sample, chrom_a, (pos_a - pos_a % 100000) // 500 AS ca, chrom_b, (pos_b - pos_b % 50000) // 500 AS cb, strand_a, strand_b FROM fin WHERE {_TOP}),
      p AS (SELECT * FROM (VALUES ('S0', 'S1'), ('S2', 'S3'), ('S4', 'S9')) t(sample_1, sample_2)),
      b AS (SELECT sample_1, sample_2, sum(CASE WHEN sample = sample_1 THEN 1 ELSE 2 END) AS sides FROM p JOIN m ON sample IN (sample_1, sample_2) GROUP BY sample_1, sample_2, chrom_a, ca, chrom_b, cb, strand_a, strand_b)
      SELECT sample_1, sample_2, count(*) FILTER (sides = 3) AS shared, count(*) FILTER (sides = 1) AS only_1, count(*) FILTER (sides = 2) AS only_2,
      round(count(*) FILTER (sides = 3) / count(*), 6) AS jaccard FROM b GROUP BY 1, 2"""),
    "pr_sweep": _fin(f""", k AS (SELECT DISTINCT {_CELL.format(w=500)}, strand_a, strand_b FROM fin WHERE first_seq % 3 = 0),
      c AS (SELECT fin.split_reads AS sr, k.chrom_a IS NOT NULL AS hit FROM fin LEFT JOIN k ON k.chrom_a = fin.chrom_a AND k.cell_a = fin.pos_a // 500 AND k.chrom_b = fin.chrom_b AND k.cell_b = fin.pos_b // 500
        AND k.strand_a = fin.strand_a AND k.strand_b = fin.strand_b)
      SELECT CAST(t AS BIGINT) AS threshold, round(CASE WHEN count(sr) > 0 THEN count(*) FILTER (hit) / count(sr) ELSE 1 END, 6) AS precision,
        round(CASE WHEN count(sr) > 0 THEN count(*) FILTER (hit) / greatest((SELECT count(*) FROM k), 1) ELSE 0 END, 6) AS recall
      FROM (SELECT unnest(range(21)) AS t) LEFT JOIN c ON sr >= t GROUP BY t"""),
    "truth_per_sample": _fin(f",{_scored('c = e', _TOP[9:-1], True)} SELECT sample, negative_control, disputed_rows, tp, fn, fp, t1_calls, exempt FROM sco"),
    "truth_score": _fin(f",{_scored('c = e', _TOP[9:-1], True)} SELECT tp, fn, fp, {_RATIO} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp FROM sco)"),
    "truth_relaxed": _fin(f",{_scored(_LAX, _TOP[9:-1], False)} SELECT sample, tp, fn, fp, exempt FROM sco"),
    "truth_junction_split": _fin(f",{_scored('c = e', chr(39) + 'T1' + chr(39), True)} SELECT sample, tp, fp, tp_detected, tp_lookup FROM sco"),
    "metadata_join": _fin(f"SELECT sample, count(*) AS n, any_value(cell_line) AS cell_line, any_value(lineage) AS lineage FROM fin LEFT JOIN (SELECT *, {_LINEAGE} FROM ({for_duckdb('metadata')})) ON sample_id = sample GROUP BY sample"),
    "cohort_lineage": f"SELECT sample_id, {_LINEAGE} FROM ({for_duckdb('metadata')})",
    "unreachable_pairs": f"WITH l AS ({for_duckdb('loci')}) SELECT ord, partner_a, partner_b FROM ({for_duckdb('partners')}) WHERE partner_a NOT IN (SELECT gene FROM l) OR partner_b NOT IN (SELECT gene FROM l)",
    "ring_angles": f"""WITH {CALLS}, t AS (SELECT chrom, max(pos) AS length, row_number() OVER (ORDER BY CAST(chrom AS INT)) AS k
        FROM (SELECT chrom_a AS chrom, pos_a AS pos FROM calls UNION ALL SELECT chrom_b, pos_b FROM calls) GROUP BY chrom)
      SELECT chrom, round(s, 6) AS start_angle, round(s + length / total * usable, 6) AS stop_angle FROM (SELECT *, (sum(length) OVER (ORDER BY k) - length) / total * usable + (k - 1) * 0.6 AS s
      FROM (SELECT *, CAST(sum(length) OVER () AS DOUBLE) AS total, CAST(360 - count(*) OVER () * 0.6 AS DOUBLE) AS usable FROM t))""",
    "call_order": _fin("SELECT sample, fusion_id, tier, row_number() OVER (PARTITION BY sample ORDER BY tier, split_reads DESC, n_callers DESC, fusion_id) - 1 AS place FROM fin WHERE tier <> 'T3'"),
    "read_filter_weight": f"""WITH {NEAR} SELECT gene, read_id, round({_W}, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY read_id) AS place FROM n0)
      WHERE place <= 5000000 AND flag & 4 = 0 AND flag & 256 = 0 AND flag & 1024 = 0 AND mapq >= 10""",
    "clip_side": f"WITH {CLIPS} SELECT read_id, side, clip, aligned, hard, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)S', 1), lambda x: CAST(x AS INT))), 0) AS BIGINT) AS soft_total FROM c2",
    "noise_clip": f"WITH {CLIPS} SELECT read_id, noise, {_noisy('seq')} AS whole_noise FROM c2",
    "sa_explode": f"""WITH {READS} SELECT read_id, p[1] AS chrom, CAST(p[2] AS BIGINT) AS pos, p[3] AS strand, p[4] AS cigar FROM (SELECT read_id,
      unnest(list_filter(list_transform(list_filter(string_split(sa, ';'), lambda x: x <> ''), lambda x: string_split(x, ',')), lambda p: len(p) >= 4 AND regexp_full_match(p[2], '-?\\d+'))) AS p FROM reads)""",
    "split_read_clusters": f"WITH {SCAN} {_CLUSTER_OUT} spl",
    "discordant_clusters": f"WITH {SCAN} {_CLUSTER_OUT} dcl",
    "read_scan": f"""WITH {EXACT_SCAN}, u AS (SELECT *, 'split' AS kind FROM spl WHERE weight >= 3 UNION ALL SELECT *, 'pair' FROM dcl WHERE weight >= 3), r AS (SELECT *, CAST({_ROUND_EVEN} AS BIGINT) AS w FROM u)
      SELECT sample, gene, kind, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, CASE kind WHEN 'split' THEN w ELSE 0 END AS split_reads, CASE kind WHEN 'split' THEN 0 ELSE w END AS discordant_pairs,
        CASE kind WHEN 'split' THEN w ELSE 0 END AS soft_clips, mapq, kind = 'split' AS precise FROM r""",
    "artefact_sa_clusters": _artefacts(),
    "reads_to_calls": f"""WITH {EXACT_SCAN}, u AS (SELECT *, true AS split FROM spl WHERE weight >= 3 UNION ALL SELECT *, false FROM dcl WHERE weight >= 3), r AS (SELECT *, CAST({_ROUND_EVEN} AS BIGINT) AS n FROM u),
      odd AS ({_artefacts("CAST(floor(avg(mapq)) AS BIGINT) AS mapq,", _TIES)}),
      c AS (SELECT 'reads' AS caller, sample, gene, chrom_a AS chrom1, chrom_b AS chrom2, pos_b // 500 AS cell, strand_a AS strand1, strand_b AS strand2,
        coalesce(min(pos_a) FILTER (split), min(pos_a)) AS pos1, coalesce(min(pos_b) FILTER (split), min(pos_b)) AS pos2,
        coalesce(max(n) FILTER (split), 0) AS split_reads, coalesce(max(n) FILTER (NOT split), 0) AS discordant_pairs, max(mapq) AS mapq, bool_or(split) AS precise FROM r GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
        UNION ALL SELECT 'reads_artefact', sample, gene, chrom_a, chrom_b, cell, strand_a, strand_b, pos_a, pos_b, n, 0, mapq, true FROM odd),
      k AS (SELECT *, row_number() OVER (ORDER BY caller, sample, gene, chrom1, chrom2, cell, strand1, strand2) - 1 AS place FROM c)
      SELECT 4611686018427387904 + place AS call_seq, concat_ws('_', caller, gene, place) AS record_id, sample, caller, {_pick("chrom1", "chrom2")} AS chrom_a, {_pick("pos1", "pos2")} AS pos_a,
        {_pick("strand1", "strand2")} AS strand_a, {_pick("chrom2", "chrom1")} AS chrom_b, {_pick("pos2", "pos1")} AS pos_b, {_pick("strand2", "strand1")} AS strand_b, split_reads, discordant_pairs,
        split_reads AS soft_clips, mapq, precise FROM k""",
    "library_stats": f"""WITH {CLIPS}, k AS (SELECT contig, max(ref_end) AS stop FROM c2 GROUP BY contig
        ORDER BY CASE contig WHEN 'chr1' THEN 0 WHEN '1' THEN 1 ELSE 2 END, contig LIMIT 1),
      o AS (SELECT c2.*, row_number() OVER w AS place, flag & 4 = 0 AND flag & 256 = 0 AND flag & 1024 = 0 AND flag & 2048 = 0 AS plain FROM c2 JOIN k USING (contig)
        WHERE contig NOT IN ('chr1', '1') OR stop <= 60000000 OR (ref_end > 30000000 AND ref_start < 60000000) WINDOW w AS (ORDER BY ref_start, read_id) QUALIFY place <= 400001),
      i AS (SELECT *, CASE WHEN plain AND abs(tlen) > 0 AND abs(tlen) < 100000 AND mapq >= 20 THEN abs(tlen) END AS length_of FROM o),
      s AS (SELECT *, place <= 400000 AS seen, CASE WHEN place <= 400000 THEN length_of END AS ins,
        CASE WHEN place <= 400000 AND plain THEN coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)S', 1), lambda x: CAST(x AS INT))), 0) END AS soft,
        CASE WHEN place <= 400000 AND plain THEN mapq END AS q FROM i QUALIFY count(length_of) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 100000),
      m AS (SELECT quantile_cont(ins, 0.5) AS med FROM s), d AS (SELECT quantile_cont(abs(ins - med), 0.5) AS mad FROM s, m)
      SELECT count(*) AS n_reads, count(ins) AS n_inserts, round(any_value(med), 6) AS insert_median, round(quantile_cont(ins, 0.95), 6) AS insert_p95, round(quantile_cont(ins, 0.99), 6) AS insert_p99,
        round(quantile_cont(soft, 0.5), 6) AS clip_median, round(quantile_cont(soft, 0.95), 6) AS clip_p95, round(quantile_cont(q, 0.5), 6) AS mapq_median, round(quantile_cont(q, 0.1), 6) AS mapq_p10,
        round(avg(CASE WHEN seen AND flag & 2048 <> 0 THEN 1.0 ELSE 0 END), 6) AS supplementary_share,
        round(avg(CASE WHEN seen AND flag & 1024 <> 0 AND flag & 2048 = 0 AND flag & 256 = 0 AND flag & 4 = 0 THEN 1.0 ELSE 0 END), 6) AS duplicate_share,
        round(any_value(mad), 6) AS insert_mad, CAST(CASE WHEN any_value(med) > 0 THEN floor(any_value(med) + 5 * any_value(mad)) ELSE 10000 END AS BIGINT) AS discordant_distance FROM s, m, d""",
    "vcf_records": _vcf("SELECT chrom, pos, id, 'N' AS ref, alt, qual, filter, 'GT:SR:PE:AD:DP' AS format, sample_value FROM rec"),
    "vcf_info": _vcf("SELECT id, info FROM rec"),
    "bnd_alt_parse": _vcf("""SELECT id, CASE WHEN is_bnd THEN split_part(to_place, ':', 1) END AS mate_chrom, CASE WHEN is_bnd THEN CAST(split_part(to_place, ':', 2) AS BIGINT) END AS mate_pos,
      CASE WHEN is_bnd THEN s1 END AS strand_a, CASE WHEN is_bnd THEN s2 END AS strand_b FROM rec"""),
    "info_format_maps": _vcf("""SELECT id, split_reads AS sr, tier, CASE WHEN NOT precise THEN '1' END AS imprecise, CAST(discordant_pairs AS VARCHAR) AS pe,
      CAST(split_reads + discordant_pairs AS VARCHAR) AS alt_depth FROM rec"""),
    "tsv_roundtrip": _fin("""SELECT fusion_id, tier, n_callers, vaf, known_partner, CAST(NULL AS BOOLEAN) AS in_frame, array_to_string(qc_flags, ',') AS qc_flags,
      array_to_string(callers_supporting, ',') AS callers_supporting FROM fin"""),
    "json_dump": _fin("SELECT fusion_id, tier, split_reads FROM fin"),
}

_EV = "split_reads, discordant_pairs, assembly_contigs, soft_clips, mapq, vaf, raw_qual, filter_pass, precise"
_ENDS = "chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b"
_PLACE = "(CAST({0} AS INT), {1})"


def _from_caller(caller: str, bnd_id: str, columns: dict[str, str], where: str = "true", strands: tuple[str, str] = ("'+'", "'-'")) -> str:
    """Calls that come back from a caller's text: breakends as they were written, other events from their
    first end to 5000 bases on, on one contig."""
    one = f"CASE WHEN sv_type = 'BND' THEN strand_a ELSE {strands[0]} END"
    two = f"CASE WHEN sv_type = 'BND' THEN strand_b ELSE {strands[1]} END"
    given = ", ".join(f"{columns.get(c, 'CAST(0 AS BIGINT)')} AS {c}" for c in _EV.split(", "))
    return f"""WITH {CALLS} SELECT {bnd_id} AS record_id, chrom_a, pos_a, {one} AS strand_a, CASE WHEN sv_type = 'BND' THEN chrom_b ELSE chrom_a END AS chrom_b,
      CASE WHEN sv_type = 'BND' THEN pos_b ELSE pos_a + 5000 END AS pos_b, {two} AS strand_b, sv_type, {given} FROM calls WHERE caller = '{caller}' AND {where}"""


_FIRST = "CASE WHEN sv_type = 'BND' THEN concat(record_id, ':1') ELSE record_id END"
_BASE = {"vaf": "CAST(0 AS DOUBLE)", "raw_qual": "raw_qual", "precise": "precise", "filter_pass": "filter_pass"}
_LOOSE = _BASE | {"filter_pass": "filter_pass OR call_seq % 2 = 0", "split_reads": "split_reads", "discordant_pairs": "discordant_pairs"}
_CT = "CASE call_seq % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END"
ORACLES |= {
    "caller_manta": _from_caller("manta", _FIRST, _LOOSE | {"assembly_contigs": "assembly_contigs", "vaf": "CAST(call_seq % 50 AS DOUBLE)"}),
    "caller_gridss": _from_caller("gridss", "concat('e', record_id)", _BASE | {"split_reads": "split_reads + 2", "discordant_pairs": "discordant_pairs",
        "assembly_contigs": "call_seq % 3 + (call_seq % 2 > 0)::INT", "soft_clips": "call_seq % 9", "mapq": "CAST(50 AS BIGINT)", "vaf": "CAST(0.25 AS DOUBLE)"}),
    "caller_delly": _from_caller("delly", "record_id", _BASE | {"split_reads": "greatest(split_reads, call_seq % 12)", "discordant_pairs": "greatest(discordant_pairs, call_seq % 6)", "assembly_contigs": "assembly_contigs",
        "mapq": "CAST(60 AS BIGINT)", "vaf": "round((call_seq % 6 + call_seq % 12) / (call_seq % 6 + call_seq % 12 + 12), 6)"}, strands=(_CT.format("+", "-", "+", "-"), _CT.format("-", "+", "+", "-"))),
    "caller_svaba": _from_caller("svaba", _FIRST, _BASE | {"split_reads": "CASE call_seq % 3 WHEN 0 THEN 0 WHEN 1 THEN greatest(split_reads, 1) ELSE split_reads END",
        "discordant_pairs": "CASE call_seq % 3 WHEN 0 THEN greatest(discordant_pairs, 1) WHEN 1 THEN 0 ELSE discordant_pairs END",
        "assembly_contigs": "CASE WHEN call_seq % 5 = 0 THEN 2 WHEN call_seq % 3 > 0 THEN 1 ELSE 0 END", "mapq": "call_seq % 61", "vaf": "round(split_reads / 40, 6)"}),
    "caller_tiddit": _from_caller("tiddit", _FIRST, _LOOSE | {"split_reads": "CASE WHEN call_seq % 2 = 0 THEN call_seq % 8 ELSE split_reads END",
        "discordant_pairs": "CASE WHEN call_seq % 2 = 0 THEN call_seq % 10 ELSE discordant_pairs END"}),
    "caller_factera": f"""WITH {CALLS} SELECT concat('factera_', chrom_a, '_', pos_a, '_', chrom_b, '_', pos_b) AS record_id, chrom_a, pos_a, CASE WHEN call_seq % 4 < 2 THEN '+' ELSE '-' END AS strand_a, chrom_b, pos_b,
      CASE WHEN call_seq % 2 = 0 THEN '+' ELSE '-' END AS strand_b, 'BND' AS sv_type, CASE WHEN split_reads > 0 AND discordant_pairs > 0 THEN least(split_reads, discordant_pairs) ELSE greatest(split_reads, discordant_pairs) END
      AS split_reads, CAST(0 AS BIGINT) AS discordant_pairs, CAST(1 AS BIGINT) AS assembly_contigs, CAST(0 AS BIGINT) AS soft_clips, CAST(0 AS BIGINT) AS mapq, CAST(0 AS DOUBLE) AS vaf, CAST(0 AS DOUBLE) AS raw_qual,
      true AS filter_pass, true AS precise FROM calls WHERE caller = 'factera' AND call_seq % 13 <> 0""",
    "vcf_scan_filter": f"""WITH {CALLS} SELECT call_seq * 2 AS line_no, concat('chr', chrom_a) AS chrom, CAST(10 AS BIGINT) AS n_fields FROM calls WHERE caller = 'manta'
      UNION ALL SELECT call_seq * 2 + 1, concat('chr', chrom_b), 10 FROM calls WHERE caller = 'manta' AND sv_type = 'BND'""",
    "mate_dedupe": f"WITH {CALLS} SELECT {_FIRST} AS record_id, call_seq * 2 AS line_no FROM calls WHERE caller = 'manta'",
}
