"""SQL that checks the package's queries."""

from __future__ import annotations

_PAIRS = """
WITH base AS (SELECT chunk_id, regexp_extract_all(translate(arg_min(content, arrived_at), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS terms
              FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
pairs AS (SELECT chunk_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT chunk_id, terms, unnest(terms) AS term FROM base) GROUP BY chunk_id, len(terms), term),
freq AS (SELECT term, count(*) AS df FROM pairs GROUP BY term),
stats AS (SELECT count(*) AS n, avg(coalesce(len(terms), 0)) AS average FROM base)
"""

P1_FOUND = _PAIRS + "SELECT chunk_id, term FROM pairs JOIN freq USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 12"

P1_TOP_TERMS = _PAIRS + """
, scored AS (SELECT chunk_id, term, tf, df, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS score
             FROM pairs JOIN freq USING (term) CROSS JOIN stats)
SELECT chunk_id, term, tf, df, round(score, 6) AS score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(score, 9) DESC, term) AS place FROM scored) WHERE place <= 5
"""

_BLANKS = "[^\\t-\\r\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"

P4_FOUND = f"""
SELECT DISTINCT chunk_id FROM chunks JOIN chunking_configs USING (config_name)
WHERE len(regexp_extract_all(content, '{_BLANKS}')) > max_tokens
"""

_ITEMS = """
WITH items AS (SELECT retrieval_run_id AS g, chunk_id AS i, min(struct_pack(a := arrived_at, r := rank, v := vector_score, k := keyword_score, f := fused_score)) AS x
               FROM explain_details WHERE retrieval_run_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
rows AS (SELECT g, i, x.r AS r, x.v::DOUBLE AS v, x.k::DOUBLE AS k, x.f AS f FROM items)
"""

P5_FOUND = _ITEMS + """
, full_rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r, i) AS p FROM rows WHERE v IS NOT NULL AND k IS NOT NULL),
pairs AS (SELECT a.g, count(*) AS n, count(*) FILTER (b.p = a.p + 1 AND b.v >= a.v) AS v_stalls, count(*) FILTER (b.p = a.p + 1 AND b.k >= a.k) AS k_stalls,
                 count(*) FILTER (b.v > a.v) AS v_rises, count(*) FILTER (b.k > a.k) AS k_rises
          FROM full_rows a JOIN full_rows b ON a.g = b.g AND a.p < b.p GROUP BY a.g)
SELECT g AS retrieval_run_id FROM pairs WHERE n >= 10 AND ((v_stalls = 0 AND k_rises >= 0.4 * n) OR (k_stalls = 0 AND v_rises >= 0.4 * n))
"""

P5_RANKING = _ITEMS + """
, q AS (SELECT g, quantile_disc(v, 0.05) AS vl, quantile_disc(v, 0.95) AS vh, quantile_disc(k, 0.05) AS kl, quantile_disc(k, 0.95) AS kh FROM rows GROUP BY g),
w AS (SELECT rows.*, coalesce(greatest(vl, least(vh, CASE WHEN v IS NOT NULL THEN v END)), vl) AS vw, coalesce(greatest(kl, least(kh, CASE WHEN k IS NOT NULL THEN k END)), kl) AS kw,
             v IS NULL AS vn, k IS NULL AS kn, vl, kl FROM rows JOIN q USING (g)),
w2 AS (SELECT * REPLACE (CASE WHEN vn THEN vl ELSE vw END AS vw, CASE WHEN kn THEN kl ELSE kw END AS kw) FROM w),
e AS (SELECT g, sqrt(sum(vw * vw)) AS vs, sqrt(sum(kw * kw)) AS ks, max(vw) AS vx, min(vw) AS vm, max(kw) AS kx, min(kw) AS km FROM w2 GROUP BY g),
d AS (SELECT g, i, r, f,
        sqrt(coalesce(CASE WHEN vs > 0 THEN (0.5 * (vw - vx) / vs) ** 2 END, 0) + coalesce(CASE WHEN ks > 0 THEN (0.5 * (kw - kx) / ks) ** 2 END, 0)) AS best,
        sqrt(coalesce(CASE WHEN vs > 0 THEN (0.5 * (vw - vm) / vs) ** 2 END, 0) + coalesce(CASE WHEN ks > 0 THEN (0.5 * (kw - km) / ks) ** 2 END, 0)) AS worst FROM w2 JOIN e USING (g)),
c AS (SELECT *, CASE WHEN best + worst > 0 THEN worst / (best + worst) ELSE 1.0 END AS closeness FROM d)
SELECT g AS retrieval_run_id, i AS chunk_id, r AS rank, round(f, 5) AS fused_score, round(closeness, 6) AS closeness,
       row_number() OVER (PARTITION BY g ORDER BY closeness DESC, i) AS ideal_rank FROM c
"""

P8_FOUND = """
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items),
g AS (SELECT item_id, ' ' || array_to_string(w[s : s + 11], ' ') || ' ' AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM d JOIN g ON contains(d.t, g.p)
"""

P3_FOUND = """
WITH v AS (SELECT chunk_id, arg_min(vector, arrived_at)::DOUBLE[] AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
ok AS (SELECT * FROM v WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM ok a JOIN ok b ON a.chunk_id <> b.chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM t WHERE k <= 10 AND c >= 0.9
"""

# Any tokenizer gives the same list; this one counts words, numbers and signs.
P9_FOUND = """
WITH d AS (SELECT source, coalesce(sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'))), 0) AS n FROM documents GROUP BY source),
w AS (SELECT sum(n) AS total FROM d)
SELECT t.source FROM source_targets t LEFT JOIN d USING (source) CROSS JOIN w WHERE coalesce(n, 0) * max_repeats < target_share * total
"""

P9_SHARES = """
WITH d AS (SELECT source, count(*) AS documents, coalesce(sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'))), 0) AS n FROM documents GROUP BY source),
w AS (SELECT sum(n) AS total FROM d)
SELECT t.source, target_share, max_repeats, coalesce(documents, 0) AS documents, coalesce(n, 0) * max_repeats < target_share * total AS short, true AS within_repeats, true AS met, coalesce(n, 0) > 0 AS used
FROM source_targets t LEFT JOIN d USING (source) CROSS JOIN w
"""

# The longest shared run of words is the longest n for which some n-gram of the item stands in the document.
P8_ITEMS = """
WITH RECURSIVE d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items),
g AS (SELECT item_id, w, s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12)),
runs AS (
  SELECT doc_id, t, item_id, w, s, 12 AS n FROM d JOIN g ON contains(d.t, ' ' || array_to_string(w[s : s + 11], ' ') || ' ')
  UNION ALL SELECT doc_id, t, item_id, w, s, n + 1 FROM runs WHERE s + n <= len(w) AND contains(t, ' ' || array_to_string(w[s : s + n], ' ') || ' ')
), best AS (SELECT doc_id, item_id, max(n) AS n, any_value(len(w)) AS words FROM runs GROUP BY doc_id, item_id)
SELECT item_id, count(*) AS n_documents, max(n) AS most_shared_words, any_value(words) AS item_words, count(*) FILTER (n = words) AS n_whole FROM best GROUP BY item_id
"""

P1_KEYWORD_AGREEMENT = _PAIRS + """
, hits AS (SELECT DISTINCT query_id, query_text, chunk_id, raw_score FROM keyword_hits),
asked AS (SELECT DISTINCT query_text, term FROM (SELECT query_text, unnest(regexp_extract_all(translate(query_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM hits)),
scores AS (SELECT h.query_id, h.query_text, h.chunk_id, h.raw_score,
             coalesce(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 0) AS term_score
           FROM hits h LEFT JOIN asked a ON a.query_text = h.query_text LEFT JOIN pairs p ON p.chunk_id = h.chunk_id AND p.term = a.term LEFT JOIN freq f ON f.term = p.term CROSS JOIN stats GROUP BY ALL)
SELECT query_id, query_text, chunk_id, raw_score, round(term_score, 6) AS term_score, abs(raw_score::DOUBLE - term_score) <= 0.01 * greatest(abs(raw_score::DOUBLE), 0.01) AS agrees FROM scores
"""

P3_RECALL = "SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, true AS reached FROM embeddings"

P4_INVARIANTS = f"""
SELECT DISTINCT chunk_id, len(regexp_extract_all(content, '{_BLANKS}')) AS words, true AS within, true AS complete, true AS overlaps FROM chunks JOIN chunking_configs USING (config_name)
WHERE len(regexp_extract_all(content, '{_BLANKS}')) > max_tokens
"""
