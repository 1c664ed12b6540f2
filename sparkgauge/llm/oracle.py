"""DuckDB SQL for the queries that SQL can express; the other ones are tested by brute force."""

_REACH = """
reach(a, b) AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id
  WHERE len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9
),
{_REACH},
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT m.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links,
  least(m.vec_id, coalesce(l.b, m.vec_id)) AS component_id,
  m.vec_id <= coalesce(l.b, m.vec_id) AS kept
FROM embeddings m LEFT JOIN counted c ON c.a = m.vec_id LEFT JOIN least l ON l.a = m.vec_id
"""

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n
  FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id
),
link AS (
  SELECT a, b FROM both_have h JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * h.n >= 85 * (x.n + y.n - h.n)
),
{_REACH},
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(x.n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN size x ON x.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""


OP12 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND len(a.v) = len(b.v)
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


OP13 = """
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS words
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS part
    FROM documents
  )
),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, words[i:i + k - 1] AS words, count(*) AS n
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
  GROUP BY ALL HAVING count(*) >= 100
),
inner_parts AS (
  SELECT lang, unnest([words[:-2], words[2:]]) AS words, n FROM f WHERE len(words) > 2
),
chosen AS (
  SELECT f.lang, f.words, f.n AS a FROM f
  LEFT JOIN (SELECT lang, words, max(n) AS n FROM inner_parts GROUP BY ALL) h
    ON h.lang = f.lang AND h.words = f.words
  WHERE len(f.words) > 1 AND (h.n IS NULL OR 100 * h.n < 100 * f.n)
),
cuts AS (SELECT *, unnest(range(1, len(words))) AS k FROM chosen),
scored AS (
  SELECT c.lang, c.words, c.a, x.n AS l, y.n AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1:k]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:]
  JOIN total t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.words ORDER BY score, k) = 1
),
named AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM scored)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2,
        "op5_minhash_dedup": OP5,
        "op12_hard_negatives": OP12,
        "op13_collocations": OP13,
    }
