"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST(least(
           coalesce(11 - len(list_filter([3000,2000,1500,1000,800,600,500,400,300,200], lambda c: n_symbols * 1000 / nullif(n_words, 0) > c)), 11),
           coalesce(11 - len(list_filter([950,900,850,800,750,700,650,600,550,500], lambda c: n_dup_lines * 1000 / nullif(n_lines, 0) > c)), 11),
           coalesce(11 - len(list_filter([480,460,440,420,400,380,360,340,320,300], lambda c: n_repeat_words * 1000 / nullif(n_words, 0) > c)), 11),
           coalesce(11 - len(list_filter([950,900,850,800,750,700,650,600,550,500], lambda c: n_upper * 1000 / nullif(word_chars, 0) > c)), 11),
           coalesce(11 - len(list_filter([30000,25000,22000,20000,18000,17000,16000,15000,14000,13000], lambda c: word_chars * 1000 / nullif(n_words, 0) > c)), 11)) AS INTEGER) AS first_step
  FROM m),
good AS (
  SELECT stratum, first_step FROM r
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
tally AS (
  SELECT s.stratum, step, (SELECT count(*) FROM good g WHERE g.stratum IS NOT DISTINCT FROM s.stratum) AS n,
         (SELECT count(*) FROM good g WHERE g.stratum IS NOT DISTINCT FROM s.stratum AND g.first_step <= step) AS k,
         (SELECT count(*) FROM (SELECT DISTINCT stratum FROM r)) AS strata
  FROM (SELECT DISTINCT stratum FROM r) s, range(1, 11) steps(step)),
terms AS (
  SELECT stratum, step, strata,
         CASE WHEN n = 0 THEN 1.0
              ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) END AS term
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tally)),
passed AS (SELECT stratum, step, sum(term) <= 0.05 / any_value(strata) AS ok FROM terms GROUP BY stratum, step),
chosen AS (
  SELECT stratum, CAST(coalesce(min(step) FILTER (NOT ok), 11) - 1 AS INTEGER) AS step FROM passed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND first_step > chosen.step AS kept, first_step, chosen.step AS step
FROM r JOIN chosen ON r.stratum IS NOT DISTINCT FROM chosen.stratum
"""

OP3 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 10
"""

def _split(table: str, above: str, path: list[str], weight: str) -> str:
    """One level of the budget tree: children full in the order of supply / weight, the rest by running whole shares."""
    name, parents = path[-1], path[:-1]
    same = " AND ".join(f"n.{p} IS NOT DISTINCT FROM u.{p}" for p in parents) or "TRUE"
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
{table}_n AS (
  SELECT {', '.join(f'n.{p}' for p in path)}, s, w, u.b AS p
  FROM (SELECT {', '.join(path)}, CAST(sum(tokens) * 3 AS HUGEINT) AS s, CAST({weight} AS HUGEINT) AS w FROM leaf GROUP BY {', '.join(path)}) AS n
  JOIN {above} AS u ON {same}),
{table}_o AS (
  SELECT *, row_number() OVER ({part} ORDER BY CASE WHEN s = 0 THEN -1 ELSE s / w END, {name} NULLS FIRST) AS i FROM {table}_n),
{table}_f AS (
  SELECT *, s = 0 OR s * sum(w) OVER ({part} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (p - coalesce(sum(s) OVER ({part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM {table}_o),
{table}_g AS (SELECT *, bool_and(f) OVER ({part} ORDER BY i) AS a FROM {table}_f),
{table}_h AS (
  SELECT *, p - coalesce(sum(s) FILTER (a) OVER ({part}), 0) AS r, sum(w) FILTER (NOT a) OVER ({part}) AS wo,
         sum(w) FILTER (NOT a) OVER ({part} ORDER BY i) AS wu FROM {table}_g),
{table} AS (
  SELECT {', '.join(path)}, CAST(CASE WHEN a THEN s ELSE CAST(r * wu AS HUGEINT) // CAST(wo AS HUGEINT) - CAST(r * (wu - w) AS HUGEINT) // CAST(wo AS HUGEINT) END AS HUGEINT) AS b
  FROM {table}_h),"""


OP5 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN right(source, 1) < '5' THEN 'forum' ELSE 'press' END AS domain, lang, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS HUGEINT) AS b FROM leaf),""" + _split(
    "l1", "root", ["domain"], "CASE domain WHEN 'forum' THEN 2 WHEN 'press' THEN 3 ELSE 1 END") + _split(
    "l2", "l1", ["domain", "lang"], "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END") + _split(
    "l3", "l2", ["domain", "lang", "source"], "CASE source WHEN 'src1' THEN 3 WHEN 'src5' THEN 2 ELSE 1 END") + """
plan AS (
  SELECT leaf.*, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS epochs, b - CASE WHEN tokens > 0 THEN (b // tokens) * tokens ELSE 0 END AS remains
  FROM leaf JOIN l3 ON leaf.domain = l3.domain AND leaf.lang IS NOT DISTINCT FROM l3.lang AND leaf.source IS NOT DISTINCT FROM l3.source),
laid AS (
  SELECT d.*, plan.tokens AS leaf_tokens, epochs, remains,
         sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source
           ORDER BY substr(md5('7:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 12), CAST(doc_id AS VARCHAR)) AS upto
  FROM d JOIN plan ON d.domain = plan.domain AND d.lang IS NOT DISTINCT FROM plan.lang AND d.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, domain, lang, source, tokens,
       CAST(epochs + CASE WHEN (remains > 0 OR leaf_tokens = 0) AND upto <= remains THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM laid
"""

OP6 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT keyed.*, common.k IS NULL AS stays FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) >= 2),
hit AS (SELECT doc_id, i FROM win JOIN twice USING (h)),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(i, i + 35)) AS i FROM hit)),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
         string_agg(v, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
total AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS N, CAST(sum(len(t)) AS BIGINT) AS L FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + (50 * CAST(len(t) AS BIGINT) * N) // L AS m FROM d, total WHERE len(t) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 50
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor, v.vec_id AS id, a.label = v.label AS same, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
  FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER r AS INTEGER) AS rank, s.id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW r AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)
QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op3_topk_histogram": OP3,
    "op5_mixing": OP5,
    "op6_line_dedup": OP6,
    "op7_near_duplicates": OP7,
    "op9_substring_dedup": OP9,
    "op11_lexical_search": OP11,
    "op12_hard_negatives": OP12,
}
