"""Comparison SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

EMBEDDING_NEAR_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good AS a JOIN good AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(m, vec_id), vec_id) AS component_id, least(coalesce(m, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

_SPANS = """repeated AS (SELECT rid, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
reached AS (SELECT rid, i, max(i + {width}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM repeated),
runs AS (SELECT rid, i, count(*) FILTER (WHERE r IS NULL OR i > r) OVER (PARTITION BY rid ORDER BY i) AS g FROM reached),
spans AS (SELECT rid, min(i) AS b, max(i) + {width} AS e FROM runs GROUP BY rid, g),
gaps AS (SELECT rid, b, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY b) AS p FROM spans)"""

SUFFIX_ARRAY_DEDUP = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
{_SPANS.format(width=400)},
kept AS (SELECT rid, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) AS head, max(e) AS last, sum(e - b) AS gone, count(*) AS n FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

SUBSTRING_DEDUP = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, i, md5(array_to_string(list_slice(t, i + 1, i + 35), ' ')) AS k FROM (SELECT rid, t, unnest(range(0, len(t) - 34)) AS i FROM d)),
{_SPANS.format(width=35)},
kept AS (SELECT rid, flatten(list(list_slice(t, p + 1, b) ORDER BY b)) AS head, max(e) AS last, sum(e - b) AS gone FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(t) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_concat(coalesce(head, []), list_slice(t, coalesce(last, 0) + 1, len(t))), ' ')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

_LETTERS = "SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS l(x, bit)"

FILTER_AUDIT = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
flags AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(least < doc_id, false) AS INTEGER) AS mask FROM w),
m AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
l AS ({_LETTERS}),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l AS a, l AS b, l AS c, l AS d, l AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, CAST(pow(2, bits[s]) AS INTEGER) AS own, CAST(list_sum(list_transform(list_slice(bits, 1, s - 1), lambda b: pow(2, b))) AS INTEGER) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
  coalesce(sum(n) FILTER (WHERE (mask & (own | coalesce(earlier, 0))) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE (mask & own) > 0 AND (mask & coalesce(earlier, 0)) = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE (mask & own) > 0 AND (mask & coalesce(earlier, 0)) > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE (mask & own) > 0 AND (mask & coalesce(earlier, 0)) = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE (mask & own) > 0 AND (mask & coalesce(earlier, 0)) = 0), 0) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
q AS MATERIALIZED (SELECT qid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS qid, item_id, list_distinct({_TERMS}) AS t FROM benchmark)),
c AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0) WHERE r <= 10"""

ORACLE = {
    "op5_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op10_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
    "op11_filter_interaction_audit": FILTER_AUDIT,
    "op12_ranked_lexical_search": RANKED_SEARCH,
}
