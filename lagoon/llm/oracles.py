"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from lagoon.llm.license_scan import TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: CRC-32 of a text's UTF-8 bytes: the reflected polynomial's table, then one step for each byte.
SHARDS = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
pairs AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b FROM documents),
sized AS (SELECT doc_id, strlen(text) + 16 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32 FROM pairs, steps),
laid AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS n FROM sized),
cut AS (SELECT *, CAST(least((2 * upto - size) * 40 // (2 * total), 39) AS INT) AS shard FROM laid)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""

#: All pairs of one label by exact cosine; components by repeated least neighbours.
EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM good),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v),
classes AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN classes ON v = vec_id LEFT JOIN degree ON a = vec_id
"""

#: Every run of consecutive pieces of the right size against every template that shares enough bigrams with the text.
LICENSES = f"""
WITH templates(template, license, body) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, string_split(trim(regexp_replace(lower(body), '[^\\pL\\pN]+', ' ', 'g')), ' ') AS w FROM templates),
tg AS (SELECT template, gram, count(*) AS there FROM (SELECT template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tw) GROUP BY ALL),
tb AS (SELECT template, license, len(w) - 1 AS b FROM tw),
plain AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(text), '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), '[^\\pL\\pN\\n]+', ' ', 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> '') AS p FROM plain),
each AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM pieces),
counted AS (SELECT doc_id, k, string_split(piece, ' ') AS w FROM each),
placed AS (SELECT doc_id, k, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM counted),
tokens AS (SELECT doc_id, string_split(array_to_string(p, ' '), ' ') AS w FROM pieces WHERE len(p) > 0),
grams AS (SELECT doc_id, unnest(range(len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tokens WHERE len(w) > 1),
hits AS (SELECT doc_id, i, template, gram, there FROM grams JOIN tg USING (gram)),
enough AS (SELECT doc_id, template, license, b FROM hits JOIN tb USING (template) GROUP BY ALL HAVING count(*) * 1.5 >= b),
runs AS (SELECT e.doc_id, e.template, e.license, e.b, s.off AS start, t.off + t.n - s.off AS words FROM enough e JOIN placed s ON s.doc_id = e.doc_id JOIN placed t ON t.doc_id = s.doc_id AND t.k >= s.k AND t.off + t.n - s.off - 1 <= e.b * 1.5 AND (t.off + t.n - s.off - 1) * 1.5 >= e.b),
common AS (SELECT r.doc_id, r.template, r.license, r.b, r.start, r.words, h.gram, least(count(*), max(there)) AS c FROM runs r JOIN hits h ON h.doc_id = r.doc_id AND h.template = r.template AND h.i >= r.start AND h.i < r.start + r.words - 1 GROUP BY ALL),
dice AS (SELECT doc_id, license, start, words, 2.0 * sum(c) / (words - 1 + b) AS dice FROM common GROUP BY doc_id, template, license, b, start, words),
best AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, start, words) AS m FROM dice WHERE dice >= 0.8),
clear AS (SELECT doc_id, start, words, max(dice) AS dice, min(license) AS license FROM best WHERE dice = m GROUP BY doc_id, start, words HAVING min(license) = max(license)),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, start, words) AS r FROM clear)
SELECT doc_id, license, dice, CAST(start AS BIGINT) AS start, CAST(words AS BIGINT) AS words FROM first WHERE r = 1
"""

NEGATIVES = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _codes(rounds: int = 4) -> str:
    """Rounds written one after the other; |p - c|^2 less |p|^2 decides, in doubles that hold every integer here."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""m{i} AS (SELECT part, vec_id, p, parts.square, b.entry, b.square - 2 * list_inner_product(p, b.c) AS off FROM parts JOIN b{i} b USING (part)),
a{i} AS MATERIALIZED (SELECT part, vec_id, any_value(p) AS p, min_by(entry, (off, entry)) AS entry, CAST(min(off) + any_value(square) AS BIGINT) AS error FROM m{i} GROUP BY part, vec_id)""")
        if i < rounds:
            steps.append(f"""u{i} AS (SELECT part, entry, k, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(p) AS x, unnest(range(len(p))) AS k FROM a{i}) GROUP BY ALL),
l{i} AS (SELECT part, entry, list(CAST(floor(CAST(s - ((s % n) + n) % n AS DOUBLE) / n) AS DOUBLE) ORDER BY k) AS c FROM u{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, c, list_inner_product(c, c) AS square FROM (SELECT b.part, b.entry, coalesce(l.c, b.c) AS c FROM b{i} b LEFT JOIN l{i} l ON l.part = b.part AND l.entry = b.entry))""")
    chain = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, unnest(range(4)) AS part, q, len(q) // 4 AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, part, p, list_inner_product(p, p) AS square FROM (SELECT vec_id, part, list_slice(q, part * w + 1, (part + 1) * w) AS p FROM cut)),
least AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256),
b0 AS MATERIALIZED (SELECT part, entry, p AS c, square FROM parts JOIN least USING (vec_id)),
{chain},
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
summed AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM coded JOIN kept USING (vec_id))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM summed CROSS JOIN books
"""


CODES = _codes()

ORACLE = {"op12_vector_codes": CODES, "op13_hard_negatives": NEGATIVES, "op3_license_scan": LICENSES, "op4_embedding_dedup": EMBEDDINGS, "op8_shard_by_bytes": SHARDS}
