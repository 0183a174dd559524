"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that holds it.
MODULES = {
    "op1_minhash_dedup": "minhash_dedup",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_substring_dedup": "substring_dedup",
    "op4_hilbert_packing": "packing",
    "op5_wavelet_tokens": "wavelet",
    "op6_language_id": "language_id",
    "op7_secret_scan": "secrets",
    "op8_line_quality": "line_quality",
    "op9_prefix_bpe": "prefix_bpe",
    "op10_multi_index": "multi_index",
    "op11_embedding_dedup": "embedding_dedup",
    "op12_prefix_trie": "prefix_trie",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"barloom.llm.{module}"), name) for name, module in MODULES.items() if importlib.util.find_spec(f"barloom.llm.{module}")}


WORDS = r"""d AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)"""

#: SQL of the operators that SQL can express within seconds on the small tables; the others are tested by brute force.
SQL = {
    "op1_minhash_dedup": "WITH RECURSIVE "
    + WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """, g AS (SELECT doc_id, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS k FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    s AS (SELECT DISTINCT doc_id, k FROM g WHERE n = 5 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN c USING (doc_id) JOIN m ON m.a = d.doc_id""",
    "op3_substring_dedup": "WITH "
    + WORDS.format(text="coalesce(text, '')")
    + """, g AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER f = 35 THEN string_agg(word, ' ') OVER f END AS k FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    r AS (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1), m AS (SELECT doc_id, pos, word, max(CASE WHEN r.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS 34 PRECEDING) AS gone FROM g LEFT JOIN r ON g.k = r.k),
    s AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM m GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op2_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents), x AS (SELECT doc_id, h, unnest(range(1, octet_length(h) + 1)) AS i FROM d),
    g AS (SELECT doc_id, i, hex(h[i:i]) AS b, CASE WHEN i + 199 <= octet_length(h) THEN md5(h[i:i + 199]) END AS k FROM x), r AS (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
    m AS (SELECT doc_id, i, b, max(CASE WHEN r.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 199 PRECEDING) AS gone FROM g LEFT JOIN r ON g.k = r.k), e AS (SELECT *, gone - lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS edge FROM m),
    s AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (edge = 1) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
    SELECT d.doc_id, octet_length(h) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op11_embedding_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e LEFT JOIN n ON n.a = vec_id JOIN m ON m.a = vec_id""",
    "op12_prefix_trie": """WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda p, i: xor(p >> 1, 3988292384 * (p & 1)), xor(a, b)), 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM o)),
    q AS (SELECT h.c, 0 AS k, p, r, t FROM h JOIN o ON o.c = h.c - h.c % 100 WHERE p < h UNION ALL SELECT o.c, 1, p, r, t FROM o JOIN h USING (c) WHERE p >= h), s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, r, t FROM q),
    x AS (SELECT c, d, t, string_agg(md5(length(r) || ':' || r || t), '') OVER (PARTITION BY c ORDER BY d) AS k FROM s UNION ALL SELECT c, 0, '', '' FROM h), n AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(length(t)) AS chars FROM x GROUP BY k),
    e AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(k, d) AS k FROM x GROUP BY c) GROUP BY k), f AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM n WHERE k <> '' GROUP BY 1),
    u AS (SELECT a.k, count(*) FILTER (f.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM n a JOIN n b ON starts_with(b.k, a.k) LEFT JOIN f ON f.k = b.k GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n, 0) AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256 FROM n JOIN u USING (k) LEFT JOIN f USING (k) LEFT JOIN e USING (k) LEFT JOIN n p ON n.k <> '' AND p.k = left(n.k, length(n.k) - 32)""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS f FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
    x AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > f, false)] AS x FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1), c AS (SELECT part, x, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM x LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5), s AS (SELECT array_to_string(list_transform(o, lambda z: substr('ABCDE', z, 1)), '') AS filter_order, i AS step, o[i] AS f, o[1:i - 1] AS past FROM o, i),
    z AS (SELECT c.*, s.*, x[f] AS fails, list_bool_or(list_transform(past, lambda y: x[y])) IS TRUE AS gone, list_sum(list_transform(x, lambda y: CAST(y AS INT))) AS k FROM c, s),
    g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM z GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g""",
}
