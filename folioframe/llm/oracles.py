"""DuckDB SQL for the queries that SQL can express; each name is that of its query."""

from folioframe.llm import url_filter
from folioframe.llm.quality_rules import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in (w, w.capitalize()))
_BROKEN = " OR ".join(f"({' OR '.join([f'CAST({r.metric} AS DOUBLE) < {r.low}'] * (r.low is not None) + [f'CAST({r.metric} AS DOUBLE) > {r.high}'] * (r.high is not None))})" for r in RULES)

op1_quality_rules = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_BROKEN}) AS kept, n_stop_words, n_lines FROM b
"""

_TERMS = ", ".join([f"('{t}', true, 0.0)" for t in url_filter.STRICT] + [f"('{t}', false, {w})" for t, w in url_filter.SOFT.items()])

op3_url_filter = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
rules(rule_verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
terms(term, strict, weight) AS (VALUES {_TERMS}),
fit AS (SELECT page_id, rule_host || rule_path AS rule, rule_verdict FROM p JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1),
h AS (SELECT page_id, count(*) FILTER (strict)::INT AS n_strict, count(*) FILTER (NOT strict)::INT AS n_soft, coalesce(sum(weight), 0)::DOUBLE AS soft_weight
      FROM p JOIN terms ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN n_strict > 0 OR soft_weight >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::INT AS n_strict, coalesce(n_soft, 0)::INT AS n_soft, coalesce(soft_weight, 0)::DOUBLE AS soft_weight
FROM p LEFT JOIN h USING (page_id) LEFT JOIN fit USING (page_id)
"""

op10_nearest = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
