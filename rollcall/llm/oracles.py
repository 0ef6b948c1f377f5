"""SQL for DuckDB that gives the same rows as some of the queries, by plainer ways."""

from __future__ import annotations

from rollcall.llm import fill_in_middle, licenses, line_dedup, passage_dedup, quality

BLANK = r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, shingle) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN repeats r USING (doc_id)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (5 * n_symbols > n_words)::INTEGER AS f1, (10 * n_dup_lines > 3 * n_lines)::INTEGER AS f2,
    (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INTEGER AS f3 FROM m
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(f1)::DOUBLE AS s1, sum(f2)::DOUBLE AS s2, sum(f3)::DOUBLE AS s3 FROM j GROUP BY host
), p AS (
  SELECT avg(1 / n) AS inv, sum(s1) / sum(n) AS m1, sum(s2) / sum(n) AS m2, sum(s3) / sum(n) AS m3 FROM h
), v AS (
  SELECT avg(power(s1 / n - m1, 2)) AS v1, avg(power(s2 / n - m2, 2)) AS v2, avg(power(s3 / n - m3, 2)) AS v3 FROM h, p
), k AS (
  SELECT p.*, greatest(m1 * (1 - m1) / greatest(v1 - m1 * (1 - m1) * inv, 1e-6) - 1, 1.0) AS k1, greatest(m2 * (1 - m2) / greatest(v2 - m2 * (1 - m2) * inv, 1e-6) - 1, 1.0) AS k2,
    greatest(m3 * (1 - m3) / greatest(v3 - m3 * (1 - m3) * inv, 1e-6) - 1, 1.0) AS k3 FROM p, v
), r AS (
  SELECT host, (s1 + m1 * k1) / (n + k1) AS r1, (s2 + m2 * k2) / (n + k2) AS r2, (s3 + m3 * k3) / (n + k3) AS r3 FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND f1 + f2 + f3 < 2 AND NOT (f1 = 1 AND r1 >= {quality.HOST_RATE} OR f2 = 1 AND r2 >= {quality.HOST_RATE} OR f3 = 1 AND r3 >= {quality.HOST_RATE}) AS kept, f1 + f2 + f3 AS n_soft_failures
FROM j JOIN r USING (host)
"""

#: Ends a WITH that has node(id) and link(a, b), both ways.
REACHED = """, reach(id, other) AS (
  SELECT id, id FROM node UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other
), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE node AS (SELECT vec_id AS id FROM embeddings), good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98
){REACHED}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN (SELECT a AS id, count(*) AS n FROM link GROUP BY a) USING (id)
"""

NEAR = rf"""
WITH RECURSIVE node AS (SELECT doc_id AS id FROM documents), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
){REACHED}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM component LEFT JOIN n ON n.doc_id = id
"""


def licence_sql() -> str:
    """The index, as rows of literals, joined to all words of all documents."""
    posted = [(k, w, i, key) for k, (_, text, keys) in enumerate(licenses.notices()) for w, i, key in licenses.postings(text, keys)]
    sizes = {k: [p for p in posted if p[0] == k] for k in range(len(licenses.notices()))}
    values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
    told = values([(k, label, len(sizes[k]), licenses.aligned_from(len(sizes[k])), sum(p[3] for p in sizes[k])) for k, (label, _, _) in enumerate(licenses.notices())])
    vocabulary = values([(w,) for w in licenses.vocabulary()])
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w
), base AS (
  SELECT doc_id, i, CASE WHEN t[i] = 'mit' AND t[i + 1] = 'license' THEN 'mit' WHEN t[i] = 'apache' AND t[i + 1] = 'license' THEN 'apache' WHEN t[i] = 'general' AND t[i + 1] = 'public' AND t[i + 2] = 'license' THEN 'gpl' END AS label FROM p
), b AS (
  SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list(DISTINCT label) AS labels FROM base WHERE label IS NOT NULL GROUP BY doc_id
), hit AS (SELECT doc_id, t[i] AS word, i - 1 AS i FROM p WHERE t[i] IN (SELECT * FROM {vocabulary})
), posted(notice, word, tpos, key) AS {values(posted)}
, notice(notice, label, size, need, n_keys) AS {told}
, found AS (
  SELECT doc_id, label, n / size::DOUBLE AS share FROM (SELECT doc_id, notice, i - tpos AS start, count(*) AS n, count(*) FILTER (WHERE key) AS keys FROM hit JOIN posted USING (word) GROUP BY ALL) JOIN notice USING (notice)
  WHERE n >= need AND keys = n_keys
), g AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id
)
SELECT w.doc_id, len(w.t)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(g.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""


ORACLES = {"op3_line_dedup": line_dedup.SQL, "op4_quality_rules": QUALITY, "op6_embedding_near_dedup": EMBEDDINGS, "op7_license_scan": licence_sql(), "op8_minhash_near_dedup": NEAR, "op11_passage_dedup": passage_dedup.SQL, "op12_fill_in_middle": fill_in_middle.SQL}
