"""SQL counterparts of corpus queries, for DuckDB over the same tables."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER span AS k, count(*) OVER span AS n FROM words
  WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + step AS i FROM repeated, range(20) AS r(step)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""


def decontaminate(window: int = 10) -> str:
    fold = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    raw = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    hits = "\n  UNION ALL\n".join(
        f"""  SELECT d.doc_id, d.i, {n} AS n, b.item_id
  FROM (SELECT doc_id, i, string_agg(word, ' ') OVER span AS k, count(*) OVER span AS n FROM doc_words
        WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) d
  JOIN item_windows b ON b.n = {n} AND d.n = {n} AND d.k = b.k"""
        for n in range(1, window + 1)
    )
    return f"""
WITH d AS (SELECT doc_id, {fold} AS ws FROM documents),
doc_words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT item_id, {fold} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least({window}, len(ws)) AS n, array_to_string(ws[s : s + least({window}, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least({window}, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)
), hits AS (
{hits}
), inside AS (
  SELECT DISTINCT doc_id, i + step AS i FROM (SELECT doc_id, i, unnest(range(n)) AS step FROM hits)
), hit_words AS (
  SELECT doc_id, count(*) AS n FROM inside GROUP BY doc_id
), parts AS (
  SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS p FROM (
    SELECT doc_id, regexp_extract_all(text, '{raw}+|[{raw[2:]}+') AS ps FROM documents SEMI JOIN hit_words USING (doc_id))
), placed AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, upto - length(part) AS low, upto AS high
  FROM (SELECT doc_id, p, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM parts)
  WHERE regexp_matches(part, '{raw}')
), spans AS (
  SELECT doc_id, string_agg(low || '-' || high, ',' ORDER BY low) AS spans FROM (
    SELECT doc_id, min(low)::BIGINT AS low, max(high)::BIGINT AS high FROM (
      SELECT doc_id, low, high, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM inside JOIN placed USING (doc_id, i))
    GROUP BY doc_id, run) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(s.spans, '') AS spans
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items m USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""


MINHASH_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS total FROM w
), shingles AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, i, total, string_agg(word, ' ') OVER span AS k, count(*) OVER span AS n FROM words
    WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE n = 5 OR (total < 5 AND i = 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM w
  UNION
  SELECT r.id, e.other FROM reach r
  JOIN (SELECT a AS node, b AS other FROM links UNION ALL SELECT b, a FROM links) e ON e.node = r.other
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.low AS component_id, w.doc_id = r.low AS kept
FROM w LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) r ON r.id = w.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
    AND len([e FOR e IN embedding IF e <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) r ON r.id = e.vec_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, string_split_regex(p, '[ \t]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents WHERE text IS NOT NULL)
), filled AS (
  SELECT piece, lang, list_filter(ws, lambda x: x <> '') AS ws FROM pieces
), words AS (
  SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM filled
), runs AS (
  SELECT lang, w, lead(w) OVER one AS w2, lead(w, 2) OVER one AS w3 FROM words WINDOW one AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, w AS phrase, 1 AS size, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, w || ' ' || w2, 2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
), candidates AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2 AND f >= 10
), cuts AS (
  SELECT c.*, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
  FROM candidates c, range(1, 3) AS r(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase
                             ORDER BY (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f), k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(ws[:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(ws[2:], ' '), a FROM candidates WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

# Costs of the cheapest edits up to each row, by state: s0 nothing yet, s1 after the system message, s2 after a user's and
# s3 after an assistant's. A state is (cost, audit, lines); structs compare by cost, then by audit.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc
), drawn AS (
  SELECT c.*, xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, bits.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations c, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM drawn, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS initial,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged
), judged AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS s0, {'c': 99999999, 'a': '', 't': []::VARCHAR[]} AS s1,
         {'c': 3, 'a': 'I', 't': ['user:']} AS s2, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, least(s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': list_append(s2.t, 'assistant:')}) FROM (
    SELECT conv_id, i, s0, s1, s3, least(s2, {'c': s0.c + 3, 'a': s0.a || 'I', 't': list_append(s0.t, 'user:')},
      {'c': s1.c + 3, 'a': s1.a || 'I', 't': list_append(s1.t, 'user:')}, {'c': s3.c + 3, 'a': s3.a || 'I', 't': list_append(s3.t, 'user:')}) AS s2
    FROM (
      SELECT w.conv_id, j.i,
        {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} AS s0,
        least({'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + keep + CASE initial WHEN 's' THEN 0 ELSE 99999999 END, 'a': s0.a || 'K', 't': list_append(s0.t, line)}) AS s1,
        least({'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t},
          {'c': s0.c + keep + as_u, 'a': s0.a || 'K', 't': list_append(s0.t, line)}, {'c': s1.c + keep + as_u, 'a': s1.a || 'K', 't': list_append(s1.t, line)},
          {'c': s3.c + keep + as_u, 'a': s3.a || 'K', 't': list_append(s3.t, line)},
          {'c': s0.c + keep + 3, 'a': s0.a || 'R', 't': list_append(s0.t, 'user:' || text)}, {'c': s1.c + keep + 3, 'a': s1.a || 'R', 't': list_append(s1.t, 'user:' || text)},
          {'c': s3.c + keep + 3, 'a': s3.a || 'R', 't': list_append(s3.t, 'user:' || text)}) AS s2,
        least({'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t},
          {'c': s2.c + keep + CASE initial WHEN 'a' THEN 0 ELSE 99999999 END, 'a': s2.a || 'K', 't': list_append(s2.t, line)},
          {'c': s2.c + keep + 3, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)}) AS s3
      FROM walk w JOIN (SELECT *, role || ':' || text AS line, CASE initial WHEN 'u' THEN 0 ELSE 99999999 END AS as_u,
                          CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 99999999 END AS keep FROM judged) j
        ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1))
)
SELECT w.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, least(s0, s3).c::BIGINT AS cost,
       least(s0, s3).a AS audit, sha256(array_to_string(least(s0, s3).t, chr(10))) AS repaired_sha256
FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.rows, 0)
"""
