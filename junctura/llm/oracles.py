"""DuckDB SQL with the same rows as the queries that SQL can express, written apart from the operators."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS following
          FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT k, sum(least(8, coalesce(following - i, 8))) AS n FROM twice GROUP BY k),
c AS (
  SELECT d.k, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (k)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars
           OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM c),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS bad FROM j GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, count(*) AS hosts, sum(n) AS total FROM h),
v AS (SELECT any_value(mean) AS mean, sum(n * (bad / n - mean) * (bad / n - mean)) / any_value(total) AS spread,
             any_value(hosts) / any_value(total) AS per FROM h, m),
p AS (SELECT mean, spread - mean * (1 - mean) * per AS extra, greatest(1.0, (mean * (1 - mean) - spread) / (spread - mean * (1 - mean) * per)) AS weight FROM v),
q AS (SELECT source, n, (bad + mean * weight) / (n + weight) AS rate, weight, mean, extra FROM h, p),
r AS (SELECT source, extra > 0 AND rate - 1.96 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 2 * mean / (1 + mean) AS rejected FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM s),
l AS (SELECT o.*, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
             (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0) AS weight_left
      FROM o WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * weight_left <= words_left * weight AS is_full FROM l),
first_open AS (SELECT words_left, weight_left FROM f WHERE NOT is_full ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST((SELECT words_left FROM first_open) AS DOUBLE) * weight / CAST((SELECT weight_left FROM first_open) AS DOUBLE) END AS target
      FROM f),
b AS (SELECT doc_id, d.source, size, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // greatest(source_size, 1) ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS seen FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.seen),
least_of AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


#: The rules by falling length.
_RULES = [("www.example.com", "en/", "allow"), ("example.com", "en/", "block"), ("net", "es/", "block"), ("net", "fr/", "block"), ("com", "", "allow")]
_RULE = " ".join(f"WHEN {_fits(h, p)} THEN '{h}/{p}'" for h, p, _ in _RULES)
_VERDICT = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RULES)


_BY = "host, k, above, form"


OP10 = rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^(?:.*?)://([^/?#]*)([^?#]*)', 1) AS h,
                  regexp_extract(coalesce(url, ''), '(?s)^(?:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT *, CASE {_RULE} END AS rule, CASE {_VERDICT} END AS said, regexp_replace(path, '[0-9]+', '<n>', 'g') AS general FROM v),
p AS (SELECT host, general, CASE WHEN general = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(substr(general, 2), '/') END AS s, count(*) AS n,
             sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS a FROM r GROUP BY ALL),
e AS (SELECT host, general, n, s, len(s) AS d, unnest(range(1, len(s) + 1)) AS k FROM p),
g AS (SELECT host, d, k, s[k] AS value, sum(n) AS n FROM e GROUP BY ALL),
wild AS (SELECT host, d, k, true AS is_wild FROM g GROUP BY host, d, k HAVING 2 * sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) > sum(n) + 2),
x AS (SELECT host, general, list(CASE WHEN is_wild THEN '*' ELSE s[k] END ORDER BY k) AS t FROM e LEFT JOIN wild USING (host, d, k) GROUP BY host, general),
own AS (SELECT host, general, coalesce(t, CAST([] AS VARCHAR[])) AS t, n, b, a FROM p LEFT JOIN x USING (host, general)),
m AS (SELECT host, t, sum(n) AS n, sum(b) AS b, sum(a) AS a FROM own GROUP BY host, t),
lv AS (SELECT *, len(t) AS d, unnest(range(1, len(t) + 1)) AS k FROM m),
tree AS (SELECT host, t, k, n, b, a, array_to_string(t[1:k - 1], '/') AS above, t[k] AS value, concat(d - k, ':', array_to_string(t[k + 1:d], '/')) AS below,
                concat(CASE WHEN t[k] = '*' THEN '*' WHEN contains(t[k], '<n>') THEN 'n' WHEN t[k] = '' THEN '' ELSE 'w' END, ':', regexp_extract(t[k], '\.[A-Za-z<>]*$')) AS form
         FROM lv),
sh AS (SELECT {_BY}, value, below, sum(n) AS n, sum(b) AS b, sum(a) AS a FROM tree GROUP BY ALL),
br AS (SELECT {_BY}, value, sum(n) AS own_n, sum(b) AS own_b, sum(a) AS own_a FROM sh GROUP BY ALL),
fa AS (SELECT {_BY}, sum(own_n) AS all_n, sum(own_b) AS all_b, sum(own_a) AS all_a, count(*) AS branches FROM br GROUP BY ALL),
ki AS (SELECT {_BY}, below, sum(n) AS kind_n FROM sh GROUP BY ALL),
fr AS (SELECT {_BY}, count(*) - 1 AS free FROM ki GROUP BY ALL),
ch AS (SELECT {_BY}, value, sum(CAST(n AS DOUBLE) * n * all_n / (CAST(own_n AS DOUBLE) * kind_n)) - any_value(own_n) AS chi
       FROM sh JOIN ki USING ({_BY}, below) JOIN br USING ({_BY}, value) JOIN fa USING ({_BY}) GROUP BY {_BY}, value),
al AS (SELECT {_BY}, value FROM ch JOIN br USING ({_BY}, value) JOIN fa USING ({_BY}) JOIN fr USING ({_BY})
       WHERE branches > 1
         AND chi <= CASE WHEN free > 0 THEN free * pow(1 - 2.0 / (9 * free) + 3.09 * sqrt(2.0 / (9 * free)), 3) ELSE 0 END + 0.05 * own_n + 1e-9
         AND (own_b + own_a = 0 OR pow(own_b / greatest(own_b + own_a, 1) - all_b / greatest(all_b + all_a, 1), 2) * (own_b + own_a)
              <= 1.96 * 1.96 * (all_b / greatest(all_b + all_a, 1)) * (1 - all_b / greatest(all_b + all_a, 1)) + 1e-9)),
me AS (SELECT *, true AS is_merged FROM al WHERE ({_BY}) IN (SELECT ({_BY}) FROM al GROUP BY {_BY} HAVING count(*) > 1)),
na AS (SELECT host, t, list(CASE WHEN is_merged THEN concat('~', form) ELSE value END ORDER BY k) AS class FROM tree LEFT JOIN me USING ({_BY}, value) GROUP BY host, t),
cl AS (SELECT host, t, coalesce(class, t) AS class, b, a FROM m LEFT JOIN na USING (host, t)),
ju AS (SELECT host, class, (sum(b) + 1) / (sum(b) + sum(a) + 2) >= 0.8 AS rejected FROM cl GROUP BY host, class)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN len(cl.class) = 0 THEN '' ELSE concat('/', array_to_string(cl.class, '/')) END AS template
FROM r JOIN own ON r.host = own.host AND r.general = own.general JOIN cl ON own.host = cl.host AND own.t = cl.t JOIN ju ON ju.host = cl.host AND ju.class = cl.class
"""

_SHARE = "CAST(1 + (1000000000 * (CAST({c} AS HUGEINT) + 2)) // ({n} + 2 * v) AS BIGINT)"


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM e GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
held AS (SELECT lang, source, term, count(*) AS c FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v, sum(c) AS lang_n FROM kept GROUP BY lang),
grp AS (SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_n), 0) AS lang_n, coalesce(sum(c), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN vocab USING (lang) LEFT JOIN held USING (lang, source) GROUP BY g.lang, g.source),
cell AS (SELECT grp.lang, grp.source, kept.term, coalesce(held.c, 0) AS c, {_SHARE.format(c="coalesce(held.c, 0)", n="n")} AS p, {_SHARE.format(c="kept.c", n="lang_n")} AS q
         FROM grp JOIN kept USING (lang) LEFT JOIN held ON held.lang = grp.lang AND held.source = grp.source AND held.term = kept.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
         FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far ON far.lang = x.lang AND far.source = x.source AND far.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 10
"""


def _draw(k: int) -> str:
    return f"CAST(concat('0x', substr(h, {8 * k + 1}, 8)) AS BIGINT) AS h{k + 1}"


OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
r AS (SELECT *, length(t) AS n, {", ".join(map(_draw, range(4)))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2,
    "op3_mixing": OP3,
    "op8_ngram_jaccard_join": OP8,
    "op10_url_filters": OP10,
    "op12_source_divergence": OP12,
    "op13_fill_in_middle": OP13,
}
