"""DuckDB SQL that states each registered query independently (the oracle).

These strings are *checks*: brute-force, single-node formulations of what
the Spark jobs compute, run by DuckDB over the same parquet tables.  They
are built from the same fixed values (word lists, patterns) so both sides
see identical constants.
"""

from __future__ import annotations

from ..functions import lookups as L
from ..functions.text import WS_CLASS
from ..operators.documents import KEEP_S, LEAST_STEM, NOUN_RULES
from ..sources.fixtures import PROFILE_BLOCKS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in sorted(items)) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def canon(x: str) -> str:
    return strip(f"lower({x})")


def pysplit(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, '{WS_CLASS}+') END)"


def token_sorted(x: str) -> str:
    return f"array_to_string(list_sort({pysplit(x)}), ' ')"


def lcs(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE "
            f"list_reduce(string_split({a}, ''), lambda prev, x: list_reduce(range(1, length({b}) + 1), "
            f"lambda nw, j: list_append(nw, CASE WHEN x = substring({b}, j, 1) THEN prev[j] + 1 "
            f"ELSE greatest(prev[j + 1], nw[j]) END), [0]), list_resize([0], length({b}) + 1, 0))"
            f"[length({b}) + 1] END)")


def gap_level(p: str, thresholds: dict | None = None) -> str:
    x = f"greatest(0.0, least(100.0, {p}))"
    parts = [f"WHEN {x} >= {(thresholds or {}).get(lv, lo)} THEN {q(lv)}" for lo, lv, _ in L.GAP_LEVELS[:-1]]
    return f"(CASE {' '.join(parts)} ELSE {q(L.GAP_LEVELS[-1][1])} END)"


# ---------------------------------------------------------------------------
# Fixture CTEs (same derivations as gapmatch.sources.fixtures)
# ---------------------------------------------------------------------------

F3_CTES = """
held_raw AS (
  SELECT DISTINCT o.o_custkey AS resume_id, p.p_name AS skill
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
req_raw AS (
  SELECT job_id, skill FROM (
    SELECT p_brand AS job_id, p_name AS skill, sum(p_size) AS s, count(*) OVER (PARTITION BY p_brand) AS k,
           sum(sum(p_size)) OVER (PARTITION BY p_brand) AS total
    FROM part GROUP BY p_brand, p_name) WHERE s * k >= total),
pairs AS (
  SELECT DISTINCT o.o_custkey AS resume_id, p.p_brand AS job_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
held AS (SELECT DISTINCT resume_id, {canon_h} AS skill FROM held_raw WHERE skill IS NOT NULL AND skill <> ''),
req AS (SELECT DISTINCT job_id, {canon_r} AS skill FROM req_raw WHERE skill IS NOT NULL AND skill <> '')
""".format(canon_h=canon("skill"), canon_r=canon("skill"))


def fuzzy_sim_cte(threshold: float = L.FUZZY_THRESHOLD) -> str:
    t = float(threshold)
    return f"""
sim_base AS (
  SELECT a, b, {token_sorted('a')} AS sa, {token_sorted('b')} AS sb
  FROM (SELECT DISTINCT skill AS a FROM req) ra, (SELECT DISTINCT skill AS b FROM held) hb),
sim_lcs AS (
  SELECT a, b, length(a) AS la, length(b) AS lb, length(sa) AS lsa, length(sb) AS lsb,
         {lcs('a', 'b')} AS lcs_r, {lcs('sa', 'sb')} AS lcs_s
  FROM sim_base),
sim AS (
  SELECT a, b, greatest(CASE WHEN la + lb = 0 THEN 100.0 ELSE 200.0 * lcs_r / (la + lb) END,
                        CASE WHEN lsa + lsb = 0 THEN 100.0 ELSE 200.0 * lcs_s / (lsa + lsb) END) AS score
  FROM sim_lcs
  WHERE 200.0 * lcs_r >= {t} * (la + lb) OR 200.0 * lcs_s >= {t} * (lsa + lsb))
"""


MATCH_STEPS = """,
rows0 AS (
  SELECT pr.resume_id, pr.job_id, r.skill, (h.skill IS NOT NULL) AS exact
  FROM pairs pr JOIN req r ON r.job_id = pr.job_id
  LEFT JOIN held h ON h.resume_id = pr.resume_id AND h.skill = r.skill),
cand AS (
  SELECT r.resume_id, r.job_id, r.skill AS req, s.b AS held, s.score
  FROM rows0 r JOIN sim s ON s.a = r.skill
  WHERE NOT r.exact
    AND EXISTS (SELECT 1 FROM held h WHERE h.resume_id = r.resume_id AND h.skill = s.b)
    AND NOT EXISTS (SELECT 1 FROM req q2 WHERE q2.job_id = r.job_id AND q2.skill = s.b)),
greedy AS (
  SELECT resume_id, job_id,
    list_reduce(list_sort(list({'req': req, 'neg': -score, 'held': held, 'score': score})),
      lambda acc, x: CASE WHEN list_contains(acc.reqs, x.req) OR list_contains(acc.helds, x.held) THEN acc
        ELSE {'reqs': list_append(acc.reqs, x.req), 'helds': list_append(acc.helds, x.held),
              'out': list_append(acc.out, {'req': x.req, 'held': x.held, 'score': x.score})} END,
      {'reqs': []::VARCHAR[], 'helds': []::VARCHAR[],
       'out': []::STRUCT(req VARCHAR, held VARCHAR, score DOUBLE)[]}).out AS out
  FROM cand GROUP BY resume_id, job_id),
assigned AS (
  SELECT resume_id, job_id, u.m.req AS req, u.m.held AS held, u.m.score AS score
  FROM (SELECT resume_id, job_id, unnest(out) AS m FROM greedy) u),
mrows AS (
  SELECT r.resume_id, r.job_id, r.skill, r.exact, a.held AS fuzzy_held, a.score AS fuzzy_score,
         (r.exact OR a.held IS NOT NULL) AS matched
  FROM rows0 r LEFT JOIN assigned a ON a.resume_id = r.resume_id AND a.job_id = r.job_id AND a.req = r.skill),
n_held AS (SELECT resume_id, count(*) AS total_resume FROM held GROUP BY resume_id),
per_pair AS (
  SELECT resume_id, job_id, count(*) AS total_required, count(*) FILTER (WHERE matched) AS total_matched,
    array_to_string(list_sort(list(skill) FILTER (WHERE matched)), '|') AS matched_skills,
    array_to_string(list_sort(list(skill) FILTER (WHERE NOT matched)), '|') AS missing_skills
  FROM mrows GROUP BY resume_id, job_id),
summary AS (
  SELECT p.resume_id, p.job_id,
    coalesce(pp.total_required, 0) AS total_required,
    coalesce(nh.total_resume, 0) AS total_resume,
    coalesce(pp.total_matched, 0) AS total_matched,
    coalesce(pp.total_required, 0) - coalesce(pp.total_matched, 0) AS total_missing,
    coalesce(nh.total_resume, 0) - coalesce(pp.total_matched, 0) AS total_extra,
    CASE WHEN coalesce(pp.total_required, 0) > 0
      THEN round_even(100.0::DOUBLE * pp.total_matched / pp.total_required, 2) ELSE 0.0 END AS match_percentage,
    coalesce(pp.matched_skills, '') AS matched_skills,
    coalesce(pp.missing_skills, '') AS missing_skills
  FROM pairs p LEFT JOIN per_pair pp ON pp.resume_id = p.resume_id AND pp.job_id = p.job_id
  LEFT JOIN n_held nh ON nh.resume_id = p.resume_id)
"""


def match_ctes(threshold: float = L.FUZZY_THRESHOLD) -> str:
    return F3_CTES + "," + fuzzy_sim_cte(threshold) + MATCH_STEPS


MATCH_CTES = match_ctes()


def match_custom_sql(threshold: float, thresholds: dict | None = None) -> str:
    return "WITH " + match_ctes(threshold) + f"""
SELECT resume_id, job_id, total_required, total_resume, total_matched, total_missing, total_extra,
       CAST(match_percentage AS DOUBLE) AS match_percentage, {gap_level('match_percentage', thresholds)} AS gap_level,
       matched_skills, missing_skills
FROM summary
"""


def match_summary_sql() -> str:
    return match_custom_sql(L.FUZZY_THRESHOLD)


# ---------------------------------------------------------------------------
# Skill string helpers in SQL
# ---------------------------------------------------------------------------

def squash(x: str) -> str:
    return f"array_to_string({pysplit(x)}, ' ')"


def valid(x: str) -> str:
    """FLT-02 in SQL."""
    s = strip(f"lower({x})")
    s_sp = f"replace({s}, '-', ' ')"
    toks = pysplit(s)
    n, n_sp = f"len({toks})", f"len({pysplit(s_sp)})"
    req, allowed, block = inlist(L.REQUIRED_MULTI), inlist(L.ALLOWED_SINGLE), inlist(L.BLOCKLIST)
    return (f"(CASE WHEN {x} IS NULL OR {s} = '' THEN false "
            f"WHEN ({n} > 1 AND {s} IN {req}) OR ({n_sp} > 1 AND {s_sp} IN {req}) THEN true "
            f"WHEN ({n} = 1 AND {s} IN {allowed}) OR ({n_sp} = 1 AND {s_sp} IN {allowed}) THEN true "
            f"WHEN {n} = 1 AND {s} IN {block} THEN false "
            f"WHEN {n} > 1 THEN len(list_filter({toks}, lambda t: NOT (t IN {block}))) > 0 "
            f"ELSE false END)")


CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[{CASED}]+|[^{CASED}]+'), "
            f"lambda r: CASE WHEN regexp_matches(r, '^[{CASED}]') THEN upper(substring(r, 1, 1)) || "
            f"lower(substring(r, 2)) ELSE r END), '')")


def display(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.DISPLAY_OVERRIDES)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE coalesce((CASE {canon(x)} {cases} END), "
            f"{title(strip(x))}) END)")


def curated_values() -> str:
    rows = []
    for i, (n, c, t, h, d) in enumerate(L.curated_skills()):
        rows.append(f"({i}, {q(n)}, {q(c)}, {q(t)}, {str(h).lower()}, {str(d).lower()})")
    return "(VALUES " + ", ".join(rows) + ") cur(cur_ord, cur_name, cur_category, cur_type, cur_hot, cur_demand)"


def defaults_values() -> str:
    rows = [f"({q(a)}, {q(c)})" for a, c in L.DEFAULT_ALIASES]
    return "(VALUES " + ", ".join(rows) + ") da(alias, canonical)"


# ---------------------------------------------------------------------------
# F2 + PL-05
# ---------------------------------------------------------------------------

def kb_ctes() -> str:
    block = inlist(L.BLOCKLIST)
    extra = lst(["Problem Solving", "Critical Thinking", "Machine Learning", "cold gear"])
    return f"""
sw AS (
  SELECT p.p_brand AS soc_code,
         CASE WHEN l.l_linenumber % 2 = 0 THEN upper(p.p_name) ELSE p.p_name END AS we,
         p.p_type AS en,
         CASE WHEN l.l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS hot,
         CASE WHEN l.l_discount > 0.05::DOUBLE THEN 'Y' ELSE 'N' END AS dem,
         lpad(CAST(l.l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l.l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l.l_partkey AS VARCHAR), 12, '0') AS ord
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
swr AS (
  SELECT {strip("coalesce(we, 'nan')")} AS raw,
         upper({strip("coalesce(hot, 'nan')")}) = 'Y' AS hot,
         upper({strip("coalesce(dem, 'nan')")}) = 'Y' AS dem,
         {strip("coalesce(en, 'nan')")} AS category,
         {strip("coalesce(soc_code, '')")} AS soc, ord
  FROM sw),
swf AS (SELECT *, lower(raw) AS skill_key FROM swr
        WHERE raw <> '' AND lower(raw) <> 'nan' AND lower(raw) NOT IN {block}),
swk AS (
  SELECT skill_key, arg_min(raw, ord) AS name, arg_min(category, ord) AS category,
         bool_or(hot) AS hot_technology, bool_or(dem) AS in_demand, count(*) AS occupations_count,
         min(ord) AS first_ord
  FROM swf GROUP BY skill_key),
socs AS (
  SELECT skill_key, list(soc ORDER BY o) AS soc_codes
  FROM (SELECT skill_key, soc, min(ord) AS o FROM swf WHERE soc <> '' GROUP BY skill_key, soc) GROUP BY skill_key),
swkb AS (
  SELECT s.skill_key, s.name, s.category, 'software' AS skill_type, s.hot_technology, s.in_demand,
         s.occupations_count, coalesce(c.soc_codes, []::VARCHAR[]) AS soc_codes, 0.0::DOUBLE AS importance_score,
         s.first_ord
  FROM swk s LEFT JOIN socs c ON c.skill_key = s.skill_key),
ess AS (
  SELECT unnest([o.o_orderpriority,
                 CASE WHEN o.o_orderkey % 3 = 0 THEN lower(c.c_mktsegment) || ' planning'
                      ELSE c.c_mktsegment || ' Planning' END,
                 {extra}[o.o_orderkey % 4 + 1]]) AS element_name,
         CAST(1 + o.o_orderkey % 5 AS DOUBLE) AS data_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
eg AS (SELECT element_name, avg(data_value) AS mean, count(data_value) AS cnt FROM ess
       WHERE element_name IS NOT NULL GROUP BY element_name),
eg2 AS (SELECT element_name, {strip('element_name')} AS raw, mean, cnt, lower({strip('element_name')}) AS skill_key
        FROM eg),
eg3 AS (SELECT * FROM eg2 WHERE raw <> '' AND skill_key <> 'nan' AND skill_key NOT IN {block}
        AND {valid('skill_key')}),
ek AS (
  SELECT skill_key, arg_min(raw, element_name) AS name, arg_min(mean, element_name) AS mean,
         arg_min(cnt, element_name) AS occupations_count, arg_max(mean, element_name) AS last_mean,
         min(element_name) AS first_element
  FROM eg3 GROUP BY skill_key),
ekb AS (SELECT skill_key, name, occupations_count, mean >= 4.0 AS in_demand,
               round_even(last_mean, 2) AS importance_score, first_element FROM ek),
merged AS (
  SELECT coalesce(s.skill_key, e.skill_key) AS skill_key,
    CASE WHEN s.skill_key IS NOT NULL THEN s.name ELSE e.name END AS name,
    CASE WHEN s.skill_key IS NOT NULL THEN s.category ELSE {q(L.ESSENTIAL_CATEGORY)} END AS category,
    CASE WHEN s.skill_key IS NOT NULL THEN 'software' ELSE 'essential' END AS skill_type,
    CASE WHEN s.skill_key IS NOT NULL THEN s.hot_technology ELSE false END AS hot_technology,
    CASE WHEN s.skill_key IS NOT NULL THEN s.in_demand ELSE e.in_demand END AS in_demand,
    CASE WHEN s.skill_key IS NOT NULL THEN s.occupations_count ELSE e.occupations_count END AS occupations_count,
    CASE WHEN s.skill_key IS NOT NULL THEN s.soc_codes ELSE []::VARCHAR[] END AS soc_codes,
    coalesce(e.importance_score, s.importance_score) AS importance_score,
    CASE WHEN s.skill_key IS NOT NULL THEN 0 ELSE 1 END AS src_rank,
    CASE WHEN s.skill_key IS NOT NULL THEN s.first_ord ELSE e.first_element END
      AS src_key
  FROM swkb s FULL OUTER JOIN ekb e ON s.skill_key = e.skill_key),
kb AS (
  SELECT coalesce(m.skill_key, lower(cur.cur_name)) AS skill_key,
    CASE WHEN m.skill_key IS NULL THEN
      (CASE WHEN length(cur.cur_name) > 4 THEN {title('cur.cur_name')} ELSE upper(cur.cur_name) END)
      ELSE m.name END AS name,
    CASE WHEN m.skill_key IS NULL THEN cur.cur_category ELSE m.category END AS category,
    CASE WHEN m.skill_key IS NULL THEN cur.cur_type ELSE m.skill_type END AS skill_type,
    CASE WHEN m.skill_key IS NULL THEN cur.cur_hot ELSE m.hot_technology OR coalesce(cur.cur_hot, false) END
      AS hot_technology,
    CASE WHEN m.skill_key IS NULL THEN cur.cur_demand ELSE m.in_demand OR coalesce(cur.cur_demand, false) END
      AS in_demand,
    CASE WHEN m.skill_key IS NULL THEN 10 ELSE m.occupations_count END AS occupations_count,
    CASE WHEN m.skill_key IS NULL THEN []::VARCHAR[] ELSE m.soc_codes END AS soc_codes,
    CASE WHEN m.skill_key IS NULL THEN (CASE WHEN cur.cur_demand THEN 4.5 ELSE 3.5 END)
      ELSE m.importance_score END::DOUBLE AS importance_score,
    CASE WHEN m.skill_key IS NULL THEN 2 ELSE m.src_rank END AS src_rank,
    CASE WHEN m.skill_key IS NULL THEN cur.cur_ord ELSE 0 END AS cur_ord,
    coalesce(m.src_key, '') AS src_key
  FROM merged m FULL OUTER JOIN {curated_values()} ON m.skill_key = lower(cur.cur_name)),
variants AS (
  SELECT skill_key, {squash("translate(skill_key, '-./', '   ')")} AS alias, src_rank, cur_ord, src_key FROM kb),
gen AS (
  SELECT alias, arg_min(skill_key, {{'a': src_rank, 'b': cur_ord, 'c': src_key}}) AS canonical
  FROM variants WHERE alias <> skill_key GROUP BY alias),
aliases AS (
  SELECT alias, canonical, 'default' AS source FROM {defaults_values()}
  UNION ALL
  SELECT alias, canonical, 'generated' AS source FROM gen
  WHERE alias NOT IN (SELECT alias FROM {defaults_values()}))
"""


def kb_software_sql() -> str:
    return "WITH " + kb_ctes() + """
SELECT skill_key, name, category, hot_technology, in_demand, occupations_count,
       array_to_string(soc_codes, '|') AS soc_codes, importance_score FROM swkb"""


def kb_essential_sql() -> str:
    return "WITH " + kb_ctes() + """
SELECT skill_key, name, occupations_count, in_demand, CAST(importance_score AS DOUBLE) AS importance_score FROM ekb"""


def kb_merge_sql() -> str:
    return "WITH " + kb_ctes() + """
SELECT skill_key, name, category, skill_type, hot_technology, in_demand, occupations_count,
       array_to_string(soc_codes, '|') AS soc_codes, CAST(importance_score AS DOUBLE) AS importance_score FROM kb"""


def alias_variants_sql() -> str:
    return "WITH " + kb_ctes() + "\nSELECT alias, canonical, source FROM aliases"


def alias_pairs_sql() -> str:
    return "WITH " + kb_ctes() + "\nSELECT alias, canonical FROM aliases"


def csv_records_sql() -> str:
    return "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"


def kb_totals_sql() -> str:
    return "WITH " + kb_ctes() + """
SELECT 'total_skills' AS metric, count(*) AS value FROM kb
UNION ALL SELECT 'hot_skills', count(*) FILTER (WHERE hot_technology) FROM kb
UNION ALL SELECT 'in_demand_skills', count(*) FILTER (WHERE in_demand) FROM kb
UNION ALL SELECT 'total_aliases', count(*) FROM aliases"""


# ---------------------------------------------------------------------------
# Documents (SC-01..04, SRC-03)
# ---------------------------------------------------------------------------

NL = "chr(10)"


def clean(x: str) -> str:
    t = f"translate(coalesce({x}, ''), {q('‘’“”–—' + chr(9))}, {q(chr(39) * 2 + '\"\"-- ')})"
    t = f"regexp_replace({t}, '[•‣◦]', ' - ', 'g')"
    t = f"regexp_replace({t}, '[^\\x20-\\x7E\\n]', ' ', 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return f"trim({t}, ' ' || {NL})"


def clean_documents_sql() -> str:
    return f"""
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS raw_chars, CAST(length(c) AS BIGINT) AS clean_chars,
       c = '' AS blank, md5(c) AS clean_md5
FROM (SELECT doc_id, text, {clean('text')} AS c FROM documents)"""


def sentence_counts_sql() -> str:
    return f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, {NL})) AS sentences_md5
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({clean('text')}, '[.!?]+(?:\\s+|\\n)'),
        lambda x: trim(x, ' ' || {NL})), lambda x: x <> '') AS s FROM documents)"""


def trained_sentences_sql() -> str:
    """SC-02 trained: counts of word pairs, likelihood ratios and decisions, all in SQL."""
    core = lambda x: f"""regexp_replace({x}, '^["''(\\[{{]+|["'')\\]}}\\s]+\\z', '', 'g')"""
    low = lambda x: f"lower(regexp_replace({x}, '[.,;:!?]+\\z', ''))"
    word = lambda x: f"(CASE WHEN regexp_matches({low(x)}, '\\A[0-9][0-9.,-]*\\z') THEN '##' ELSE {low(x)} END)"
    mark = lambda x: (f"(CASE WHEN regexp_matches({x}, '[!?]\\z|\\.\\.\\z') THEN '!' WHEN ends_with({x}, '.') THEN '.' "  # noqa: E731
                      f"WHEN regexp_matches({x}, '\\.[,;:]+\\z') THEN ',' ELSE '' END)")
    lg = lambda k, n, p: (f"(CASE WHEN {k} > 0 AND {p} > 0 THEN {k} * ln({p}) ELSE 0 END + "  # noqa: E731
                          f"CASE WHEN {n} - {k} > 0 AND 1 - ({p}) > 0 THEN ({n} - {k}) * ln(1 - ({p})) ELSE 0 END)")
    ratio = (f"CASE WHEN ab / a > b / n THEN -2 * ({lg('ab', 'a', 'b / n')} + {lg('(b - ab)', '(n - a)', 'b / n')} "
             f"- {lg('ab', 'a', 'ab / a')} - {lg('(b - ab)', '(n - a)', '(b - ab) / greatest(n - a, 1)')}) ELSE 0 END")
    return f"""
WITH docs AS (SELECT doc_id, {clean('text')} AS t FROM documents),
cores AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\\S+'), lambda x: {core('x')}) AS c FROM docs),
at_ AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM cores),
tok AS (SELECT doc_id, i, {word('c[i]')} AS w, {mark('c[i]')} AS mark,
               CASE WHEN i < len(c) THEN {word('c[i + 1]')} END AS x,
               regexp_matches(c[i + 1][1:1], '[A-Z]') AS upper FROM at_),
pairs AS (SELECT w, mark, x, count(*) AS n FROM tok GROUP BY ALL),
words AS (SELECT w, CAST(sum(n) AS DOUBLE) AS a, CAST(sum(CASE WHEN mark IN ('.', ',') THEN n ELSE 0 END) AS DOUBLE) AS ab
          FROM pairs GROUP BY w),
tot AS (SELECT sum(a) AS n, sum(ab) AS p FROM words),
abb0 AS (SELECT w, a, ab, n, p, length(replace(w, '.', '')) AS k, length(w) - length(replace(w, '.', '')) + 1 AS dots
         FROM words, tot WHERE regexp_matches(w, '\\A[a-z][a-z.&-]*\\z') AND ab > 0),
abb AS (SELECT w FROM abb0 WHERE -2 * ({lg('ab', 'a', 'p / n')} - {lg('ab', 'a', '0.99')}) * exp(-k) * dots
                                 * pow(k, ab - a) >= 0.3),
marked AS (SELECT pairs.*, abb.w IS NOT NULL OR pairs.w = '##' OR regexp_matches(pairs.w, '\\A[a-z]\\z') AS held
           FROM pairs LEFT JOIN abb USING (w) WHERE mark IN ('.', '!')),
ends AS (SELECT * FROM marked WHERE mark = '!' OR NOT held),
st0 AS (SELECT x, sum(n) AS ab FROM ends WHERE regexp_matches(x, '\\A[a-z]+\\z') GROUP BY x),
st AS (SELECT x FROM (SELECT st0.x, CAST(st0.ab AS DOUBLE) AS ab, words.a AS b, (SELECT CAST(sum(n) AS DOUBLE) FROM ends) AS a,
                             (SELECT n FROM tot) AS n FROM st0 JOIN words ON words.w = st0.x) WHERE {ratio} >= 30),
co0 AS (SELECT w, x, CAST(sum(n) AS DOUBLE) AS ab FROM marked
        WHERE mark = '.' AND held AND x IS NOT NULL AND x NOT IN (SELECT x FROM st) GROUP BY w, x HAVING sum(n) > 1),
co AS (SELECT w, x FROM (SELECT co0.w, co0.x, co0.ab, p.ab AS a, q.a AS b, (SELECT n FROM tot) AS n
                         FROM co0 JOIN words p ON p.w = co0.w JOIN words q ON q.w = co0.x) WHERE {ratio} >= 7.88),
held AS (SELECT doc_id, list(i) AS held FROM (
  SELECT tok.doc_id, i FROM tok LEFT JOIN abb ON abb.w = tok.w LEFT JOIN st ON st.x = tok.x
         LEFT JOIN co ON co.w = tok.w AND co.x = tok.x
  WHERE mark = '.' AND tok.x IS NOT NULL
    AND (abb.w IS NOT NULL OR tok.w = '##' OR regexp_matches(tok.w, '\\A[a-z]\\z'))
    AND (co.w IS NOT NULL OR NOT (upper AND (tok.w = '##' OR st.x IS NOT NULL)))) GROUP BY doc_id),
parts AS (SELECT doc_id, regexp_extract_all(t, '\\S+\\s*') AS p, coalesce(held, []) AS held
          FROM docs LEFT JOIN held USING (doc_id)),
cut AS (SELECT doc_id, string_split(array_to_string(list_transform(range(1, len(p) + 1), lambda i:
          CASE WHEN regexp_matches({core('p[i]')}, '[!?]\\z|\\.\\.\\z')
                 OR (ends_with({core('p[i]')}, '.') AND NOT list_contains(held, i)) THEN p[i] || chr(1) ELSE p[i] END), ''),
          chr(1)) AS s FROM parts),
fin AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x, ' ' || {NL})), lambda x: x <> '') AS s FROM cut)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, {NL})) AS sentences_md5 FROM fin"""


def content(toks: str) -> str:
    return f"list_filter({toks}, lambda t: NOT (t IN {inlist(L.STOP_WORDS)}) AND length(t) > 1)"


def word_tokens_expr(x: str) -> str:
    return f"regexp_extract_all(lower({clean(x)}), '\\b[a-z0-9+#.-]+\\b')"


def word_tokens_sql() -> str:
    return f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(c) AS BIGINT) AS n_content,
       md5(array_to_string(t, ' ')) AS tokens_md5, md5(array_to_string(c, ' ')) AS content_md5
FROM (SELECT doc_id, t, {content('t')} AS c FROM (SELECT doc_id, {word_tokens_expr('text')} AS t FROM documents))"""



def lemma(x: str) -> str:
    """Noun lemma of a token: the longest of the suffix rules."""
    whens = []
    for old, new in sorted(NOUN_RULES, key=lambda r: (-len(r[0]), r[0])):
        hit = f"suffix({x}, {q(old)}) AND length({x}) >= {len(old) + LEAST_STEM}"
        if old == "s":
            hit += "".join(f" AND NOT suffix({x}, {q(k)})" for k in KEEP_S)
        whens.append(f"WHEN {hit} THEN left({x}, length({x}) - {len(old)}) || {q(new)}")
    return f"(CASE {' '.join(whens)} ELSE {x} END)"


def lemma_line(text: str) -> str:
    return f"array_to_string(list_transform({content(word_tokens_expr(text))}, lambda t: {lemma('t')}), ' ')"


def lemma_text_sql() -> str:
    return f"""WITH j AS (SELECT doc_id, coalesce({lemma_line('text')}, '') AS lt FROM documents)
SELECT doc_id, CAST(length(lt) AS BIGINT) AS lemma_chars, md5(lt) AS lemma_md5,
       substring(lt, 1, 300) || '...' AS preview FROM j"""


def induced_lemma_text_sql() -> str:
    """SC-04 by a lexicon that SQL induces itself; the rules are written out here."""
    return f"""
WITH t AS (SELECT doc_id, {content(word_tokens_expr('text'))} AS t FROM documents),
v AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM t) GROUP BY term),
rules(rule, repl, k) AS (VALUES ('s', '', 1), ('ses', 's', 2), ('ves', 'f', 3), ('xes', 'x', 4), ('zes', 'z', 5),
                                ('ches', 'ch', 6), ('shes', 'sh', 7), ('men', 'man', 8), ('ies', 'y', 9)),
led AS (SELECT v.term, rule, b.term AS base, b.n AS base_n
        FROM v JOIN rules ON ends_with(v.term, rule) AND length(v.term) >= length(rule) + 2
               JOIN v b ON b.term = left(v.term, length(v.term) - length(rule)) || repl
        WHERE regexp_matches(v.term, '\\A[a-z]+\\z') AND regexp_matches(b.term, '\\A[a-z]+\\z')),
par AS (SELECT base, string_agg(rule, '+' ORDER BY rule) AS paradigm FROM (SELECT DISTINCT base, rule FROM led) GROUP BY base),
lex AS (SELECT base FROM par WHERE paradigm IN (SELECT paradigm FROM par GROUP BY paradigm HAVING count(*) >= 5)),
cand AS (SELECT term, 0 AS k, term AS c FROM v
         UNION ALL SELECT v.term, k, left(v.term, length(v.term) - length(rule)) || repl
         FROM v JOIN rules ON ends_with(v.term, rule)),
ruled AS (SELECT term, c AS lemma FROM cand WHERE c IN (SELECT base FROM lex)
          QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(c), k, c) = 1),
known AS (SELECT * FROM led WHERE base IN (SELECT base FROM lex)),
most AS (SELECT term, base FROM known QUALIFY row_number() OVER (PARTITION BY term ORDER BY base_n DESC, base) = 1),
least AS (SELECT term, base FROM known QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(base), base) = 1),
exc AS (SELECT most.term, most.base AS lemma FROM most JOIN least USING (term) WHERE most.base <> least.base),
lem AS (SELECT v.term, coalesce(exc.lemma, ruled.lemma, v.term) AS lemma
        FROM v LEFT JOIN exc USING (term) LEFT JOIN ruled ON ruled.term = v.term),
j AS (SELECT t.doc_id, string_agg(lemma, ' ' ORDER BY i) AS lt
      FROM (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS i FROM t) x JOIN lem USING (term)
           RIGHT JOIN t ON t.doc_id = x.doc_id GROUP BY t.doc_id)
SELECT doc_id, CAST(length(coalesce(lt, '')) AS BIGINT) AS lemma_chars, md5(coalesce(lt, '')) AS lemma_md5,
       substring(coalesce(lt, ''), 1, 300) || '...' AS preview FROM j"""


def assemble_pages_sql() -> str:
    ok = "'Successfully extracted text from ' || CAST(n_pages AS VARCHAR) || ' page(s).'"
    return f"""
WITH p AS (SELECT conv_id AS doc_id, turn AS page_no, coalesce(text, '') AS t FROM conversations),
g AS (SELECT doc_id, count(*) AS n_pages,
             coalesce(list(t ORDER BY page_no, t) FILTER (WHERE {strip('t')} <> ''), []::VARCHAR[]) AS kept
      FROM p GROUP BY doc_id),
o AS (SELECT doc_id, n_pages, CAST(len(kept) AS BIGINT) AS n_text_pages,
             {strip(f"array_to_string(kept, {NL})")} AS text FROM g)
SELECT doc_id, n_pages, n_text_pages, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_chars,
       CASE WHEN n_pages = 0 THEN {q(L.STATUS_NO_PAGES)} WHEN text = '' THEN {q(L.STATUS_NO_TEXT)} ELSE {ok} END
         AS status
FROM o"""


# ---------------------------------------------------------------------------
# F1 + PL-01 (extraction)
# ---------------------------------------------------------------------------

TOKEN_PIECE_RE = r"\s*(?:(?:https?://|www\.)\S+|\S+@\S+|[\pL\pN_]+(?:\.[\pL\pN_]+)*(?:\+\+|#)?|\S)"


def section_classes_sql(x: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({x}, {q(rx)}) THEN {q(c)}" for c, rx in L.section_classes())
    return f"(CASE {parts} END)"


def section_display_sql(x: str) -> str:
    parts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.SECTION_DISPLAY.items())
    return f"coalesce((CASE {x} {parts} END), {q(L.SECTION_DISPLAY['body'])})"


def section_rank_sql(x: str) -> str:
    parts = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(L.SECTION_ORDER))
    return f"coalesce((CASE {x} {parts} END), 99)"


def profile_ctes() -> str:
    blocks = lst(PROFILE_BLOCKS)
    return f"""
prof AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN blk || {NL} || coalesce(text, '')
                      ELSE coalesce(text, '') || {NL} || blk END AS text
  FROM (SELECT doc_id, text, {blocks}[doc_id % {len(PROFILE_BLOCKS)} + 1] AS blk FROM documents)),
d AS (SELECT doc_id, c AS clean FROM (SELECT doc_id, {clean('text')} AS c FROM prof) WHERE c <> ''),
lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(clean, {NL}) AS ls FROM d)),
lsec AS (
  SELECT doc_id, line_no, line,
         coalesce(last_value(cls IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'summary') AS section
  FROM (SELECT doc_id, line_no, line, {section_classes_sql("trim(line)")} AS cls FROM lines))
"""


def _special_rows() -> str:
    """One SELECT per special pattern, emulating its look-arounds by
    inspecting the characters around every occurrence of the literal."""
    word = "'[a-z0-9_]'"
    specs = [
        ("c++", "[a-z0-9_#]", "[a-z0-9_+]", None, "c++"),
        ("c#", "[a-z0-9_#]", "[a-z0-9_#]", None, "c#"),
        (".net", "[a-z0-9_]", "[a-z0-9_]", None, ".net"),
        ("node.js", "[a-z0-9_]", "[a-z0-9_]", None, "node.js"),
        ("react.js", "[a-z0-9_]", "[a-z0-9_]", None, "react"),
        ("vue.js", "[a-z0-9_]", "[a-z0-9_]", None, "vue.js"),
        ("r", "[a-z0-9_]", "[a-z0-9_]", r"^\s*(?:programming|language|script|code|studio|,|$)", "r"),
        ("c", "[a-z0-9_]", "[a-z0-9_]", r"^\s*(?:programming|language|compiler|,|$)", "c"),
    ]
    del word
    sels = []
    for core, left, right, ahead, term in specs:
        cq = q(core)
        prev = (f"CASE WHEN pc[i] <> '' THEN right(pc[i], 1) WHEN i = 1 THEN '' ELSE right({cq}, 1) END")
        nxt = (f"CASE WHEN pc[i + 1] <> '' THEN left(pc[i + 1], 1) WHEN i + 1 = len(pc) THEN '' "
               f"ELSE left({cq}, 1) END")
        before = f"array_to_string(list_slice(pc, 1, i), {cq})"
        cond = f"NOT regexp_matches({prev}, {q(left)}) AND NOT regexp_matches({nxt}, {q(right)})"
        if ahead:
            cond += f" AND regexp_matches(array_to_string(list_slice(pc, i + 1, len(pc)), {cq}), {q(ahead)})"
        sels.append(f"""
  SELECT doc_id, {q(term)} AS term,
         length({before}) - length(replace({before}, {NL}, '')) AS line_no
  FROM (SELECT doc_id, pc, unnest(range(1, len(pc))) AS i
        FROM (SELECT doc_id, string_split(lower(clean), {cq}) AS pc FROM d))
  WHERE {cond}""")
    return " UNION ALL ".join(sels)


def extract_ctes(knowledge: str | None = None) -> str:
    tokens_p = f"list_transform(regexp_extract_all(lower(p), {q(TOKEN_PIECE_RE)}), lambda x: ltrim(x))"
    acr_all = " ".join(L.ACRONYM_CANDIDATES)
    return (knowledge or kb_ctes()) + "," + profile_ctes() + f""",
specials AS ({_special_rows()}),
dict0 AS (SELECT DISTINCT p FROM (SELECT skill_key AS p FROM kb UNION ALL SELECT alias AS p FROM aliases)),
dict1 AS (SELECT p, trim(lower(p), ' ' || chr(9) || {NL} || chr(13) || chr(11) || chr(12)) AS ps FROM dict0),
dictionary AS (
  SELECT DISTINCT array_to_string({tokens_p}, ' ') AS key, len({tokens_p}) AS n
  FROM dict1 WHERE length(ps) >= 2 AND ps NOT IN {inlist(L.BLOCKLIST)} AND {valid('ps')}),
toks AS (
  SELECT doc_id, line_no, section, pc, list_transform(pc, lambda x: ltrim(x)) AS tk
  FROM (SELECT doc_id, line_no, section, regexp_extract_all(lower(line), {q(TOKEN_PIECE_RE)}) AS pc FROM lsec)),
grams AS (
  SELECT t.doc_id, t.line_no, t.section, t.pc, t.tk, n.n, unnest(range(1, len(t.tk) - n.n + 2)) AS start
  FROM toks t, (SELECT DISTINCT n FROM dictionary) n WHERE len(t.tk) >= n.n),
spans AS (
  SELECT g.doc_id, g.line_no, g.section, g.start, g.n,
         ltrim(array_to_string(list_slice(g.pc, g.start, g.start + g.n - 1), '')) AS raw
  FROM grams g JOIN dictionary k
    ON k.n = g.n AND k.key = array_to_string(list_slice(g.tk, g.start, g.start + g.n - 1), ' ')),
kept AS (
  SELECT doc_id, line_no, u.k.s AS start, u.k.n AS n, u.k.raw AS raw, u.k.sec AS section
  FROM (SELECT doc_id, line_no, unnest(list_reduce(
          list_sort(list({{'neg': -n, 's': start, 'e': start + n, 'n': n, 'raw': raw, 'sec': section}})),
          lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x.e AND x.s < k.e)) > 0 THEN acc
                              ELSE list_append(acc, x) END,
          []::STRUCT(neg INTEGER, s BIGINT, e BIGINT, n INTEGER, raw VARCHAR, sec VARCHAR)[])) AS k
        FROM spans GROUP BY doc_id, line_no) u),
acr_keys AS (SELECT alias FROM aliases WHERE alias IN {inlist(L.ACRONYM_CANDIDATES)}),
acronyms AS (
  SELECT DISTINCT doc_id, line_no, section, unnest(regexp_extract_all(lower(line),
         '\\b(' || (SELECT string_agg(a, '|' ORDER BY list_position({lst(L.ACRONYM_CANDIDATES)}, a))
                    FROM (SELECT alias AS a FROM acr_keys)) || ')\\b', 1)) AS raw
  FROM lsec WHERE (SELECT count(*) FROM acr_keys) > 0),
cands AS (
  SELECT s.doc_id, s.term AS raw, l.section FROM specials s JOIN lsec l ON l.doc_id = s.doc_id AND l.line_no = s.line_no
  UNION ALL SELECT doc_id, trim(raw), section FROM kept
  UNION ALL SELECT doc_id, raw, section FROM acronyms),
cv AS (SELECT doc_id, raw, section,
              regexp_replace({strip('lower(raw)')}, '^[^\\pL\\pN_+#]+|[^\\pL\\pN_+#]+$', '', 'g') AS s
       FROM cands WHERE {valid('raw')}),
norm AS (
  SELECT cv.doc_id, cv.section,
         CASE WHEN cv.s = '' THEN '' ELSE coalesce(a0.canonical, a1.canonical, a2.canonical, cv.s) END AS skill
  FROM cv
  LEFT JOIN aliases a0 ON a0.alias = cv.s
  LEFT JOIN aliases a1 ON a1.alias = replace(cv.s, '-', ' ')
  LEFT JOIN aliases a2 ON a2.alias = {squash("translate(cv.s, './', '  ')")}),
det AS (SELECT DISTINCT doc_id, skill, {section_display_sql('section')} AS section FROM norm
        WHERE skill <> '' AND {valid('skill')}),
extracted AS (
  SELECT doc_id, skill, {display('skill')} AS display_name,
         array_to_string(list_transform(list_sort(list({{'r': {section_rank_sql('section')}, 's': section}})),
                                        lambda x: x.s), ' + ') AS evidence
  FROM det GROUP BY doc_id, skill)
"""


def section_spans_sql() -> str:
    return "WITH " + profile_ctes() + f""",
ll AS (SELECT doc_id, line_no, length(line) + 1 AS len,
              {section_classes_sql("trim(line)")} AS cls FROM lines),
pos AS (SELECT doc_id, line_no, cls, coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        sum(len) OVER (PARTITION BY doc_id) AS total FROM ll),
b AS (SELECT doc_id, -1 AS line_no, 'summary' AS section, 0 AS start, max(total) AS total FROM pos GROUP BY doc_id
      UNION ALL SELECT doc_id, line_no, cls, start, total FROM pos WHERE cls IS NOT NULL)
SELECT doc_id, section, CAST(start AS BIGINT) AS start,
       CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY line_no), total) AS BIGINT) AS "end"
FROM b"""


def special_terms_sql() -> str:
    return "WITH " + profile_ctes() + f""",
specials AS ({_special_rows()})
SELECT s.doc_id, s.term, CAST(s.line_no AS BIGINT) AS line_no, l.section, count(*) AS n_matches
FROM specials s JOIN lsec l ON l.doc_id = s.doc_id AND l.line_no = s.line_no
GROUP BY s.doc_id, s.term, s.line_no, l.section"""


def phrase_matches_sql() -> str:
    return "WITH " + extract_ctes() + """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n, raw,
       section FROM spans"""


def longest_spans_sql() -> str:
    return "WITH " + extract_ctes() + """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n, raw
FROM kept"""


def extract_skills_sql() -> str:
    return "WITH " + extract_ctes() + "\nSELECT doc_id, skill, display_name, evidence FROM extracted"


def skill_details_sql() -> str:
    return "WITH " + extract_ctes() + f"""
SELECT e.doc_id, e.skill AS skill_key, e.display_name,
       coalesce(k.category, {q(L.DEFAULT_CATEGORY_EXTRACTED)}) AS category,
       coalesce(k.hot_technology, false) AS hot_technology, coalesce(k.in_demand, false) AS in_demand,
       CAST(coalesce(k.importance_score, 0.0) AS DOUBLE) AS importance_score, e.evidence
FROM extracted e LEFT JOIN kb k ON k.skill_key = e.skill"""


def context_reject_sql() -> str:
    names = sorted(L.COMPANY_PLATFORM_NAMES)
    rx = r"\b(?:" + "|".join(names) + r")\b"
    contact = "|".join("(?:" + p + ")" for p in L.CONTACT_INDICATORS)
    return "WITH " + profile_ctes() + f""",
m AS (SELECT doc_id, clean, regexp_split_to_array(lower(clean), {q(rx)}) AS pc,
             regexp_extract_all(lower(clean), {q(rx)}) AS ms FROM d),
x AS (SELECT doc_id, clean, pc, ms, unnest(range(1, len(ms) + 1)) AS k FROM m WHERE len(ms) > 0),
y AS (SELECT doc_id, clean, ms[k] AS term,
             length(array_to_string(list_slice(pc, 1, k), '')) + length(array_to_string(list_slice(ms, 1, k - 1), ''))
               AS off FROM x)
SELECT doc_id, term, CAST(off AS BIGINT) AS "offset",
       CAST(len(string_split(substring(clean, 1, off), {NL})) - 1 AS BIGINT) AS line_no,
       regexp_matches(lower(substring(clean, greatest(0, off - {L.CONTEXT_WINDOW}) + 1,
                      least(length(clean), off + length(term) + {L.CONTEXT_WINDOW}) - greatest(0, off - {L.CONTEXT_WINDOW}))),
                      {q(contact)}) AS rejected
FROM y"""


def valid_skills_sql() -> str:
    return "WITH " + profile_ctes() + f""",
t AS (SELECT regexp_extract_all(lower(clean), '\\b[a-z0-9+#.-]+\\b') AS t FROM d),
terms AS (
  SELECT DISTINCT term FROM (
    SELECT unnest(t) AS term FROM t
    UNION ALL
    SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM t))
SELECT term, {valid('term')} AS valid FROM terms"""


# ---------------------------------------------------------------------------
# PL-03 (direct TF-IDF formula, independent of the closed form)
# ---------------------------------------------------------------------------

TFIDF_TEXTS = "SELECT 'r' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'j', item_id, text FROM benchmark"
TFIDF_PAIRS = """
pairs AS (SELECT doc_id AS resume_id, doc_id % (SELECT count(*) FROM benchmark) AS job_id FROM documents),"""


def tfidf_ctes(cap: int, texts: str = TFIDF_TEXTS, pairs: str = TFIDF_PAIRS) -> str:
    stops2 = inlist(L.VECTORIZER_STOP_WORDS)
    return f"""
alltxt AS ({texts}),
docs AS (SELECT side, id, coalesce({lemma_line('text')}, '') AS lt FROM alltxt),
vt AS (SELECT side, id, lt <> '' AS nonblank,
              list_filter(regexp_extract_all(lower(lt), '\\b\\w\\w+\\b'), lambda t: NOT (t IN {stops2})) AS v FROM docs),
terms AS (SELECT side, id, unnest(v || list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS term
          FROM vt),
tf AS (SELECT side, id, term, count(*) AS cnt FROM terms GROUP BY side, id, term),{pairs}
u0 AS (SELECT p.resume_id, p.job_id, t.term, t.cnt AS r, 0 AS j FROM pairs p JOIN tf t ON t.side = 'r' AND t.id = p.resume_id
       UNION ALL
       SELECT p.resume_id, p.job_id, t.term, 0 AS r, t.cnt AS j FROM pairs p JOIN tf t ON t.side = 'j' AND t.id = p.job_id),
u1 AS (SELECT resume_id, job_id, term, sum(r) AS r, sum(j) AS j FROM u0 GROUP BY resume_id, job_id, term),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY r + j DESC, term ASC) AS rk
                     FROM u1) WHERE rk <= {cap}),
wts AS (SELECT resume_id, job_id, term,
               r * (CASE WHEN r > 0 AND j > 0 THEN 1.0 ELSE 1.0 + ln(1.5) END) AS wr,
               j * (CASE WHEN r > 0 AND j > 0 THEN 1.0 ELSE 1.0 + ln(1.5) END) AS wj FROM u),
nrm AS (SELECT resume_id, job_id, sqrt(sum(wr * wr)) AS nr, sqrt(sum(wj * wj)) AS nj,
               count(*) FILTER (WHERE wr > 0 AND wj > 0) AS n_shared, count(*) AS vocab FROM wts
        GROUP BY resume_id, job_id),
ov AS (SELECT w.resume_id, w.job_id, w.term, w.wr * w.wj AS prod,
              CASE WHEN n.nr > 0 AND n.nj > 0 THEN (w.wr / n.nr) * (w.wj / n.nj) ELSE 0.0 END AS ow
       FROM wts w JOIN nrm n ON n.resume_id = w.resume_id AND n.job_id = w.job_id),
cosv AS (SELECT resume_id, job_id, sum(ow) AS cos FROM ov GROUP BY resume_id, job_id),
top AS (SELECT * FROM (SELECT resume_id, job_id, term, ow,
          row_number() OVER (PARTITION BY resume_id, job_id ORDER BY prod DESC, term DESC) AS rank
        FROM ov WHERE ow > 0) WHERE rank <= {L.TOP_SHARED_TERMS}),
t5 AS (SELECT resume_id, job_id, string_agg(term, ', ' ORDER BY rank) AS t5 FROM top WHERE rank <= {L.EXPLAIN_TERMS}
       GROUP BY resume_id, job_id),
flags AS (SELECT p.resume_id, p.job_id, coalesce(vr.nonblank, false) AS rb, coalesce(vj.nonblank, false) AS jb
          FROM pairs p LEFT JOIN vt vr ON vr.side = 'r' AND vr.id = p.resume_id
          LEFT JOIN vt vj ON vj.side = 'j' AND vj.id = p.job_id)
"""


def tfidf_scores_sql(cap: int) -> str:
    return "WITH " + tfidf_ctes(cap) + f"""
SELECT f.resume_id, f.job_id,
  CASE WHEN NOT (f.rb AND f.jb) OR coalesce(n.vocab, 0) = 0 THEN 0.0 ELSE round_even(coalesce(c.cos, 0.0), 4) END
    AS cosine_similarity_score,
  CASE WHEN NOT (f.rb AND f.jb) OR coalesce(n.vocab, 0) = 0 THEN 0.0
       ELSE greatest(0.0, least(100.0, round_even(coalesce(c.cos, 0.0) * 100.0, 2))) END
    AS text_similarity_percentage,
  CAST(CASE WHEN NOT (f.rb AND f.jb) OR coalesce(n.vocab, 0) = 0 THEN 0 ELSE n.n_shared END AS BIGINT)
    AS n_shared_terms,
  CASE WHEN NOT (f.rb AND f.jb) THEN {q(L.SIMILARITY_EMPTY_MSG)}
       WHEN coalesce(n.vocab, 0) = 0 THEN {q(L.SIMILARITY_EMPTY_VOCAB_MSG)}
       WHEN t5.t5 IS NOT NULL THEN {q(L.SIMILARITY_PREFIX_MSG)} || t5.t5 || '.'
       ELSE {q(L.SIMILARITY_NO_OVERLAP_MSG)} END AS explanation
FROM flags f LEFT JOIN nrm n ON n.resume_id = f.resume_id AND n.job_id = f.job_id
LEFT JOIN cosv c ON c.resume_id = f.resume_id AND c.job_id = f.job_id
LEFT JOIN t5 ON t5.resume_id = f.resume_id AND t5.job_id = f.job_id"""


def tfidf_top_sql(cap: int) -> str:
    return "WITH " + tfidf_ctes(cap) + """
SELECT resume_id, job_id, CAST(rank AS BIGINT) AS rank, term, round_even(ow, 4) AS overlap_weight FROM top"""


# ---------------------------------------------------------------------------
# PL-02 outputs, PL-04, AG-13/14, PL-07, PL-06 on the F3 stand-ins
# ---------------------------------------------------------------------------

def fuzzy_pairs_sql() -> str:
    return "WITH " + F3_CTES + "," + fuzzy_sim_cte() + "\nSELECT a, b, score FROM sim"


def fuzzy_assign_sql() -> str:
    return "WITH " + MATCH_CTES + "\nSELECT resume_id, job_id, req, held, score FROM assigned"


EVIDENCE_CTE = """
ev AS (
  SELECT resume_id, skill, array_to_string(list_transform(list_sort(list(DISTINCT r)),
         lambda k: ['Skills section', 'Experience section', 'Project section', 'Education section',
                    'Summary section'][k]), ' + ') AS evidence
  FROM (SELECT o.o_custkey AS resume_id, lower(p.p_name) AS skill, CAST(left(o.o_orderpriority, 1) AS INTEGER) AS r
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)
  GROUP BY resume_id, skill)
"""


def evidence_rows() -> str:
    fuzzy = (f"coalesce(fe.evidence, {q(L.EVIDENCE_DEFAULT_MATCHED)}) || ' (fuzzy match ' || "
             f"CAST(CAST(round_even(m.fuzzy_score, 0) AS BIGINT) AS VARCHAR) || '%)'")
    return "WITH " + MATCH_CTES + "," + EVIDENCE_CTE + f""",
reqrows AS (
  SELECT m.resume_id, m.job_id, m.skill,
         CASE WHEN m.matched THEN {q(L.STATUS_MATCHED)} ELSE {q(L.STATUS_MISSING)} END AS status,
         CASE WHEN m.fuzzy_held IS NOT NULL THEN {fuzzy}
              WHEN m.exact THEN coalesce(nullif(e.evidence, ''), {q(L.EVIDENCE_DEFAULT_MATCHED)})
              ELSE {q(L.EVIDENCE_MISSING)} END AS evidence,
         'Required' AS type, 0 AS grp
  FROM mrows m LEFT JOIN ev e ON e.resume_id = m.resume_id AND e.skill = m.skill
  LEFT JOIN ev fe ON fe.resume_id = m.resume_id AND fe.skill = m.fuzzy_held),
extras AS (
  SELECT p.resume_id, p.job_id, h.skill FROM pairs p JOIN held h ON h.resume_id = p.resume_id
  WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.job_id = p.job_id AND r.skill = h.skill)
    AND NOT EXISTS (SELECT 1 FROM assigned a WHERE a.resume_id = p.resume_id AND a.job_id = p.job_id
                    AND a.held = h.skill)),
exrows AS (
  SELECT x.resume_id, x.job_id, x.skill, {q(L.STATUS_EXTRA)} AS status,
         coalesce(nullif(e.evidence, ''), {q(L.EVIDENCE_DEFAULT_EXTRA)}) AS evidence, 'Additional' AS type, 1 AS grp
  FROM extras x LEFT JOIN ev e ON e.resume_id = x.resume_id AND e.skill = x.skill),
allr AS (SELECT * FROM reqrows UNION ALL SELECT * FROM exrows),
evt AS (SELECT resume_id, job_id, CAST(row_number() OVER (PARTITION BY resume_id, job_id ORDER BY grp, skill) AS BIGINT) AS pos,
       skill AS skill_key, {display('skill')} AS skill, status, evidence, type
FROM allr)"""


def evidence_table_sql() -> str:
    return evidence_rows() + "\nSELECT * FROM evt"


def evidence_map_sql() -> str:
    return evidence_rows() + f""",
e AS (SELECT resume_id, job_id, skill_key || '=' || CASE WHEN status = {q(L.STATUS_EXTRA)} THEN 'extra'
        WHEN status = {q(L.STATUS_MATCHED)} THEN 'matched' ELSE 'missing' END || '=' || evidence || '=' || skill AS x,
        skill_key FROM evt)
SELECT resume_id, job_id, string_agg(x, '|' ORDER BY skill_key) AS entries FROM e GROUP BY resume_id, job_id"""


def _priority_sql(hot, dem, imp, occ) -> str:
    return (f"(CASE WHEN {hot} OR {dem} OR {imp} >= 4.0 THEN {q(L.PRIORITY_HIGH)} "
            f"WHEN {occ} >= 3 OR {imp} >= 3.0 THEN {q(L.PRIORITY_MEDIUM)} ELSE {q(L.PRIORITY_LOW)} END)")


def _reason_sql(hot, dem, imp, occ) -> str:
    a, b = L.REASON_IMPORTANCE.split("{importance}")
    c, d = L.REASON_MEDIUM.split("{count}")
    return (f"(CASE WHEN {hot} AND {dem} THEN {q(L.REASON_HOT_AND_DEMAND)} WHEN {hot} THEN {q(L.REASON_HOT)} "
            f"WHEN {dem} THEN {q(L.REASON_DEMAND)} "
            f"WHEN {imp} >= 4.0 THEN {q(a)} || CAST({imp} AS VARCHAR) || {q(b)} "
            f"WHEN {occ} >= 3 OR {imp} >= 3.0 THEN {q(c)} || CAST({occ} AS VARCHAR) || {q(d)} "
            f"ELSE {q(L.REASON_LOW)} END)")


def recs_ctes() -> str:
    return kb_ctes() + "," + MATCH_CTES + recs_steps()


def recs_steps() -> str:
    return f""",
missing AS (SELECT resume_id, job_id, skill FROM mrows WHERE NOT matched),
recs0 AS (
  SELECT m.resume_id, m.job_id, {canon('m.skill')} AS skill_key,
         coalesce(k.name, {title('m.skill')}) AS skill,
         coalesce(k.category, {q(L.DEFAULT_CATEGORY_MISSING)}) AS category,
         coalesce(k.hot_technology, false) AS hot, coalesce(k.in_demand, false) AS dem,
         coalesce(k.occupations_count, 1) AS occ, CAST(coalesce(k.importance_score, 0.0) AS DOUBLE) AS imp
  FROM missing m LEFT JOIN kb k ON k.skill_key = {canon('m.skill')}),
recs AS (
  SELECT resume_id, job_id, skill_key, skill, category, {_priority_sql('hot', 'dem', 'imp', 'occ')} AS priority,
         {_reason_sql('hot', 'dem', 'imp', 'occ')} AS reason, hot AS hot_technology, dem AS in_demand,
         imp AS importance_score
  FROM recs0),
prio AS (
  SELECT resume_id, job_id, count(*) AS total_recommended,
         count(*) FILTER (WHERE priority = {q(L.PRIORITY_HIGH)}) AS high_count,
         count(*) FILTER (WHERE priority = {q(L.PRIORITY_MEDIUM)}) AS medium_count,
         count(*) FILTER (WHERE priority = {q(L.PRIORITY_LOW)}) AS low_count
  FROM recs GROUP BY resume_id, job_id)
"""


def recommendations_sql() -> str:
    return "WITH " + recs_ctes() + """
SELECT resume_id, job_id, skill_key, skill, category, priority, reason, hot_technology, in_demand, importance_score
FROM recs"""


def alignment_counts_sql() -> str:
    return "WITH " + MATCH_CTES + """
SELECT resume_id, job_id, 'Matched Skills' AS category, CAST(total_matched AS BIGINT) AS count FROM summary
UNION ALL SELECT resume_id, job_id, 'Missing Skills', CAST(total_missing AS BIGINT) FROM summary
UNION ALL SELECT resume_id, job_id, 'Extra Skills', CAST(total_extra AS BIGINT) FROM summary"""


def priority_counts_sql() -> str:
    return "WITH " + recs_ctes() + f"""
SELECT resume_id, job_id, {q(L.PRIORITY_HIGH)} AS priority, CAST(high_count AS BIGINT) AS count FROM prio
UNION ALL SELECT resume_id, job_id, {q(L.PRIORITY_MEDIUM)}, CAST(medium_count AS BIGINT) FROM prio
UNION ALL SELECT resume_id, job_id, {q(L.PRIORITY_LOW)}, CAST(low_count AS BIGINT) FROM prio"""


def pair_summary_sql() -> str:
    desc = " ".join(f"WHEN {q(lv)} THEN {q(d)}" for _, lv, d in L.GAP_LEVELS)
    return "WITH " + recs_ctes() + f""",
s AS (SELECT *, {gap_level('match_percentage')} AS gap_level FROM summary)
SELECT s.resume_id, s.job_id, CAST(s.match_percentage AS DOUBLE) AS match_percentage, s.gap_level,
       (CASE s.gap_level {desc} END) AS gap_description, s.total_matched, s.total_missing, s.total_extra,
       CAST(coalesce(p.high_count, 0) AS BIGINT) AS high_priority_count
FROM s LEFT JOIN prio p ON p.resume_id = s.resume_id AND p.job_id = s.job_id"""


def evaluate_extraction_sql() -> str:
    cl = f"regexp_replace({strip('lower(r.skill)')}, '^[^\\pL\\pN_+#]+|[^\\pL\\pN_+#]+$', '', 'g')"
    return "WITH " + kb_ctes() + "," + F3_CTES + f""",
t0 AS (SELECT p.resume_id, p.job_id, p.job_id AS domain, {cl} AS s
       FROM pairs p JOIN req_raw r ON r.job_id = p.job_id),
truth AS (
  SELECT DISTINCT t0.resume_id, t0.job_id, t0.domain,
         CASE WHEN t0.s = '' THEN '' ELSE coalesce(a0.canonical, a1.canonical, a2.canonical, t0.s) END AS skill
  FROM t0 LEFT JOIN aliases a0 ON a0.alias = t0.s
  LEFT JOIN aliases a1 ON a1.alias = replace(t0.s, '-', ' ')
  LEFT JOIN aliases a2 ON a2.alias = {squash("translate(t0.s, './', '  ')")}),
tr AS (SELECT DISTINCT resume_id, job_id, skill FROM truth WHERE skill <> ''),
pr AS (SELECT DISTINCT p.resume_id, p.job_id, h.skill FROM pairs p JOIN held h ON h.resume_id = p.resume_id),
j AS (SELECT coalesce(tr.resume_id, pr.resume_id) AS resume_id, coalesce(tr.job_id, pr.job_id) AS job_id,
             coalesce(tr.skill, pr.skill) AS skill, tr.skill IS NOT NULL AS in_t, pr.skill IS NOT NULL AS in_p
      FROM tr FULL OUTER JOIN pr ON tr.resume_id = pr.resume_id AND tr.job_id = pr.job_id AND tr.skill = pr.skill),
per AS (
  SELECT resume_id, job_id, count(*) FILTER (WHERE in_t AND in_p) AS tp, count(*) FILTER (WHERE NOT in_t) AS fp,
         count(*) FILTER (WHERE NOT in_p) AS fn,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE in_t AND in_p)), '|'), '') AS tp_skills,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE NOT in_t)), '|'), '') AS fp_skills,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE NOT in_p)), '|'), '') AS fn_skills
  FROM j GROUP BY resume_id, job_id),
per2 AS (SELECT per.*, per.job_id AS domain FROM per),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0.0 END AS jaccard FROM per2),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per),
tm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0.0 END AS jaccard FROM tot)
SELECT 'sample' AS level, resume_id, job_id, domain, tp, fp, fn, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       jaccard, tp_skills, fp_skills, fn_skills FROM m
UNION ALL
SELECT 'total', NULL, NULL, NULL, CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT), precision, recall,
       CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END,
       jaccard, NULL, NULL, NULL FROM tm"""


# ---------------------------------------------------------------------------
# SC-19 / SC-06 on noisy F3 strings
# ---------------------------------------------------------------------------

NOISY_CTE = f"""
noisy AS (
  SELECT o.o_custkey AS resume_id, {{'a': l.l_orderkey, 'b': l.l_linenumber, 'c': l.l_partkey}} AS pos,
         CASE l.l_linenumber WHEN 1 THEN upper(p.p_name) || ','
                             WHEN 2 THEN replace(p.p_name, ' ', '-')
                             WHEN 3 THEN '  ' || p.p_name || '.'
                             WHEN 4 THEN replace(p.p_name, ' ', '.')
                             WHEN 5 THEN replace(p.p_name, ' ', '/')
                             WHEN 6 THEN {lst(["ML", "Power-BI", "ci/cd", "React.js", "MS Excel", "node js", "Sklearn", "(Python)", "AWS;"])}[l.l_partkey % 9 + 1]
                             ELSE p.p_name END AS raw
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)
"""


def normalize_skills_sql() -> str:
    ua = "(VALUES ('HOT ROD', ' Hot-Rod Racing ')) ua(alias, canonical)"
    cl = f"regexp_replace({strip('lower(raw)')}, '^[^\\pL\\pN_+#]+|[^\\pL\\pN_+#]+$', '', 'g')"
    return "WITH " + kb_ctes() + "," + NOISY_CTE + f""",
ua2 AS (SELECT {strip('lower(alias)')} AS alias, {strip('lower(canonical)')} AS canonical FROM {ua}),
al AS (SELECT alias, canonical FROM aliases WHERE alias NOT IN (SELECT alias FROM ua2 WHERE alias <> '' AND canonical <> '')
       UNION ALL SELECT alias, canonical FROM ua2 WHERE alias <> '' AND canonical <> ''),
n0 AS (SELECT resume_id, pos, {cl} AS s FROM noisy),
n1 AS (SELECT n0.resume_id, n0.pos,
              CASE WHEN n0.s = '' THEN '' ELSE coalesce(a0.canonical, a1.canonical, a2.canonical, n0.s) END AS skill
       FROM n0 LEFT JOIN al a0 ON a0.alias = n0.s
       LEFT JOIN al a1 ON a1.alias = replace(n0.s, '-', ' ')
       LEFT JOIN al a2 ON a2.alias = {squash("translate(n0.s, './', '  ')")}),
first AS (SELECT resume_id, skill, min(pos) AS p FROM n1 WHERE skill <> '' GROUP BY resume_id, skill),
lists AS (SELECT resume_id, list(skill ORDER BY p) AS skills FROM first GROUP BY resume_id),
counts AS (SELECT resume_id, count(*) AS n_raw FROM noisy GROUP BY resume_id)
SELECT c.resume_id, c.n_raw, CAST(coalesce(len(l.skills), 0) AS BIGINT) AS n_skills,
       coalesce(array_to_string(l.skills, '|'), '') AS skills
FROM counts c LEFT JOIN lists l ON l.resume_id = c.resume_id"""


def display_names_sql() -> str:
    return "WITH " + kb_ctes() + "," + NOISY_CTE + f""",
terms AS (SELECT DISTINCT term FROM (SELECT skill_key AS term FROM kb UNION ALL SELECT raw AS term FROM noisy))
SELECT term, {display('term')} AS display_name,
       CASE WHEN length(term) > 4 THEN {title('term')} ELSE upper(term) END AS curated_display
FROM terms"""


def evaluate_profiles_sql() -> str:
    from ..sources.fixtures import PROFILE_TRUTH
    labels = "[" + ", ".join(lst(t) for t in PROFILE_TRUTH) + "]"
    cl = f"regexp_replace({strip('lower(raw)')}, '^[^\\pL\\pN_+#]+|[^\\pL\\pN_+#]+$', '', 'g')"
    n = len(PROFILE_TRUTH)
    return "WITH " + extract_ctes() + f""",
t0 AS (SELECT doc_id, doc_id % {n} AS domain, unnest({labels}[doc_id % {n} + 1]) AS raw FROM documents),
t1 AS (SELECT doc_id, domain, {cl} AS s FROM t0),
truth AS (
  SELECT DISTINCT t1.doc_id, t1.domain,
         CASE WHEN t1.s = '' THEN '' ELSE coalesce(a0.canonical, a1.canonical, a2.canonical, t1.s) END AS skill
  FROM t1 LEFT JOIN aliases a0 ON a0.alias = t1.s
  LEFT JOIN aliases a1 ON a1.alias = replace(t1.s, '-', ' ')
  LEFT JOIN aliases a2 ON a2.alias = {squash("translate(t1.s, './', '  ')")}),
tr AS (SELECT DISTINCT doc_id, skill FROM truth WHERE skill <> ''),
pr AS (SELECT DISTINCT doc_id, skill FROM extracted),
j AS (SELECT coalesce(tr.doc_id, pr.doc_id) AS doc_id, coalesce(tr.skill, pr.skill) AS skill,
             tr.skill IS NOT NULL AS in_t, pr.skill IS NOT NULL AS in_p
      FROM tr FULL OUTER JOIN pr ON tr.doc_id = pr.doc_id AND tr.skill = pr.skill),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE in_t AND in_p) AS tp, count(*) FILTER (WHERE NOT in_t) AS fp,
         count(*) FILTER (WHERE NOT in_p) AS fn,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE in_t AND in_p)), '|'), '') AS tp_skills,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE NOT in_t)), '|'), '') AS fp_skills,
         coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE NOT in_p)), '|'), '') AS fn_skills
  FROM j GROUP BY doc_id),
per2 AS (SELECT per.*, d.domain FROM per LEFT JOIN (SELECT DISTINCT doc_id, domain FROM truth) d
         ON d.doc_id = per.doc_id),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0.0 END AS jaccard FROM per2),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per),
tm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0.0 END AS jaccard FROM tot)
SELECT 'sample' AS level, doc_id, domain, tp, fp, fn, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       jaccard, tp_skills, fp_skills, fn_skills FROM m
UNION ALL
SELECT 'total', NULL, NULL, CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT), precision, recall,
       CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END,
       jaccard, NULL, NULL, NULL FROM tm"""


def priority_buckets_sql() -> str:
    level = lambda p: (f"coalesce(string_agg(skill_key || ':' || category, '|' ORDER BY pos) "  # noqa: E731
                       f"FILTER (WHERE priority = {q(p)}), '')")
    return "WITH " + recs_ctes() + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY skill_key) AS pos FROM recs)
SELECT resume_id, job_id, {level(L.PRIORITY_HIGH)} AS high, {level(L.PRIORITY_MEDIUM)} AS medium,
       {level(L.PRIORITY_LOW)} AS low FROM placed GROUP BY resume_id, job_id"""


def skill_lists_sql() -> str:
    return "WITH " + extract_ctes() + """
SELECT doc_id, string_agg(DISTINCT skill, '|' ORDER BY skill) AS skills FROM extracted GROUP BY doc_id"""


def fallback_extract_sql() -> str:
    kb = f"kb AS (SELECT unnest({lst(L.FALLBACK_SKILLS)}) AS skill_key),\n"
    al = f"aliases AS (SELECT alias, canonical, 'default' AS source FROM {defaults_values()})"
    return "WITH " + extract_ctes(kb + al) + "\nSELECT doc_id, skill, display_name, evidence FROM extracted"


def analyze_pairs_sql() -> str:
    """PL-01 on both sides, PL-02, PL-03, PL-04 and PL-07 over profiles and their successors."""
    texts = "SELECT 'r' AS side, doc_id AS id, text FROM prof UNION ALL SELECT 'j', doc_id, text FROM prof"
    return "WITH " + extract_ctes() + """,
pairs AS (SELECT a.doc_id AS resume_id, b.doc_id AS job_id FROM prof a JOIN prof b ON b.doc_id - 1 = a.doc_id),
held AS (SELECT DISTINCT doc_id AS resume_id, skill FROM extracted),
req AS (SELECT DISTINCT doc_id AS job_id, skill FROM extracted),
""" + fuzzy_sim_cte() + MATCH_STEPS + recs_steps() + "," + tfidf_ctes(L.TFIDF_MAX_FEATURES, texts, "") + f"""
SELECT s.resume_id, s.job_id, CAST(s.match_percentage AS DOUBLE) AS match_percentage,
       {gap_level('s.match_percentage')} AS gap_level, s.total_matched, s.total_missing, s.total_extra,
       CAST(coalesce(p.high_count, 0) AS BIGINT) AS high_priority_count,
       CASE WHEN NOT (f.rb AND f.jb) OR coalesce(n.vocab, 0) = 0 THEN 0.0
            ELSE greatest(0.0, least(100.0, round_even(coalesce(c.cos, 0.0) * 100.0, 2))) END
         AS text_similarity_percentage, s.matched_skills, s.missing_skills
FROM summary s LEFT JOIN prio p ON p.resume_id = s.resume_id AND p.job_id = s.job_id
JOIN flags f ON f.resume_id = s.resume_id AND f.job_id = s.job_id
LEFT JOIN nrm n ON n.resume_id = s.resume_id AND n.job_id = s.job_id
LEFT JOIN cosv c ON c.resume_id = s.resume_id AND c.job_id = s.job_id"""
