"""SQL for the queries that SQL can express."""

_RANKED = """
WITH one AS (
  SELECT query_id, doc_id, kw, coverage, tfidf, vec,
    row_number() OVER (PARTITION BY query_id, doc_id ORDER BY scored_at DESC) AS n FROM score_lists
), weighted AS (
  SELECT q.query_id, CASE WHEN w.w_kw > 0 THEN w.w_kw ELSE 1 END AS w_kw, CASE WHEN w.w_vec > 0 THEN w.w_vec ELSE 1 END AS w_vec, q.judged
  FROM search_queries q LEFT JOIN ranker_weights w USING (ranker)
), long AS (
  SELECT query_id, doc_id, u.list, CASE WHEN isfinite(u.s) AND u.s > 0 THEN u.s END AS s
  FROM one, unnest([{'list': 'kw', 's': kw}, {'list': 'coverage', 's': coverage}, {'list': 'tfidf', 's': tfidf}, {'list': 'vec', 's': vec}]) AS t(u)
  WHERE n = 1
), sized AS (
  SELECT *, count(*) FILTER (WHERE list = 'kw') OVER (PARTITION BY query_id) AS candidates,
    rank() OVER (PARTITION BY query_id, list ORDER BY s DESC NULLS LAST) AS r,
    count(*) OVER (PARTITION BY query_id, list, s) AS ties FROM long
), normal AS (
  SELECT query_id, doc_id, list, CASE WHEN s IS NULL THEN 1.0::DOUBLE ELSE (r + (ties - 1) / 2.0::DOUBLE) / candidates END AS x,
    CASE WHEN list = 'vec' THEN w_vec ELSE w_kw END AS w, judged FROM sized JOIN weighted USING (query_id)
), pairs AS (
  SELECT a.query_id, a.doc_id, least(a.x, b.x) AS lo, greatest(a.x, b.x) AS hi, (CASE WHEN a.x < b.x THEN a.w ELSE b.w END)::INT AS n, (a.w + b.w)::INT AS m
  FROM normal a JOIN normal b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.list < b.list
), stable AS (
  SELECT query_id, doc_id, exp(round(avg(ln(least(hi ** m, list_sum(list_transform(range(n, m + 1), lambda i: (factorial(m) / (factorial(i::INT) * factorial((m - i)::INT)))::DOUBLE * lo ** i * (1 - lo) ** (m - i)))))), 12)) AS p
  FROM pairs GROUP BY ALL
), probable AS (
  SELECT query_id, doc_id, judged, any_value(p) AS p, sum(x * w) / sum(w) AS mean_rank FROM normal JOIN stable USING (query_id, doc_id) GROUP BY ALL
)
"""

_CURRENT = """
WITH latest AS (
  SELECT doc_id, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY revision DESC, indexed_at DESC, tokens DESC NULLS LAST) AS n FROM doc_tokens
), records AS (
  SELECT doc_id, list_filter(tokens, lambda t: t IS NOT NULL AND t <> '') AS tokens FROM latest WHERE n = 1 AND tokens IS NOT NULL
), tf AS (
  SELECT doc_id, len(tokens) AS doc_len, term, count(*) AS tf FROM records, unnest(tokens) AS t(term) GROUP BY ALL
), stats AS (
  SELECT term, sum(tf)::BIGINT AS gf, count(*) AS df, sum(tf * ln(tf)) AS s FROM tf GROUP BY term
), n AS (SELECT count(*) AS n FROM records)
"""

SQL = {
    "p1_found": _RANKED + "SELECT query_id, doc_id FROM probable WHERE judged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, mean_rank, doc_id) <= 3",
    "p1_ranking": _RANKED + "SELECT query_id, doc_id, round(least(1, 2 * p) + 1e-11, 9) AS significance, round(mean_rank + 1e-11, 9) AS mean_rank FROM probable",
    "p5_found": _CURRENT + "SELECT doc_id, term FROM tf JOIN stats USING (term) WHERE tf >= 3 AND tf * 20 >= doc_len AND df BETWEEN 2 AND 5",
    "p5_weights": _CURRENT + "SELECT doc_id, term, tf, df, round(ln(1 + tf) * greatest(0, 1 - (ln(gf) - s / gf) / ln(n)), 6) AS weight FROM tf JOIN stats USING (term), n",
    "p6_found": _CURRENT + "SELECT term, CASE WHEN df = 1 THEN 'rare' ELSE 'common' END AS mark FROM stats, n WHERE df = 1 OR df * 100 >= 30 * n",
    "p6_counts": _CURRENT + "SELECT term, gf AS occurrences, df AS records, CASE WHEN df = 1 THEN 'rare' WHEN df * 100 >= 30 * n THEN 'common' END AS mark FROM stats, n",
    "p7_found": r"""
WITH now AS (
  SELECT document_id, page, text FROM pdf_pages WHERE document_id IS NOT NULL AND page IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY extracted_at DESC NULLS LAST, text DESC NULLS LAST) = 1
), parts AS (
  SELECT document_id, page, string_split(regexp_replace(regexp_replace(text, '\n[ \t]*\n', chr(10) || chr(1) || chr(10), 'g'), '([.!?]["''\)\]»”’]*)(\s)', '\1 ' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM now
), counted AS (
  SELECT document_id, page, list_max(list_transform(parts, lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')))) AS longest FROM parts
)
SELECT document_id, page FROM counted WHERE longest > 300
""",
}

SQL["p2_found"] = """
WITH v AS (
  SELECT DISTINCT vec_id, elements FROM doc_vectors
  WHERE len(elements) = 64 AND len(list_filter(elements, lambda x: isfinite(x))) = 64 AND list_sum(list_transform(elements, lambda x: abs(x))) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.elements::DOUBLE[], b.elements::DOUBLE[]) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) <= 10
)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM near WHERE c >= 0.90
"""

_GRAMS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, i, substring(text, i::INT, 200) AS s FROM d, unnest(range(1, length(text) - 198)) AS t(i))
"""
SQL["p10_found"] = _GRAMS + """, u AS (SELECT DISTINCT doc_id, s FROM g)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id
"""
SQL["p10_shared"] = _GRAMS + """, m AS (SELECT s FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
o AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM g WHERE s IN (SELECT s FROM m)),
c AS (SELECT doc_id, sum(least(200, coalesce(j, i + 200) - i))::BIGINT AS n FROM o GROUP BY doc_id),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text)
SELECT doc_id, coalesce(first, doc_id) AS cls, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars
FROM documents LEFT JOIN f USING (text) LEFT JOIN c USING (doc_id)
"""
SQL["p10_links"] = _GRAMS + """, f AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY text), u AS (SELECT DISTINCT doc_id, s FROM g WHERE doc_id IN (SELECT doc_id FROM f))
SELECT DISTINCT a.doc_id AS cls_a, b.doc_id AS cls_b FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id
"""
