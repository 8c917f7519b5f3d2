"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from . import url_filter

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98), {_REACH},
degree AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, l.b), vec_id) AS component_id, coalesce(least(vec_id, l.b), vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least_ l ON l.a = e.vec_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM w WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM cut),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, l.b), d.doc_id) AS component_id, coalesce(least(d.doc_id, l.b), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ l ON l.a = d.doc_id
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM s),
size AS (SELECT DISTINCT n FROM win),
at_ AS (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS s FROM d, size),
hit AS (SELECT doc_id, s, a.n, item_id FROM at_ a JOIN win ON win.n = a.n AND win.k = array_to_string(w[s:s + a.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
at_ AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) AS s FROM d),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM at_),
first_ AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first_ USING (k) WHERE f < doc_id)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_itq": EMBEDDINGS,
        "op5_minhash_near_dedup": NEAR_DUPLICATES,
        "op7_benchmark_decontamination": CONTAMINATION,
        "op8_url_filter": url_filter.ORACLE,
        "op10_substring_dedup": REPEATS,
    }
