"""DuckDB statements for the rows of the registered queries."""

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), spots AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM spots
), firsts AS (
  SELECT h, min(doc_id) AS lowest FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > lowest
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w
         ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('mix-1:' || CAST(coalesce(doc_id, 9223372036854775807) AS VARCHAR)) AS o FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM docs GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources
), sums AS (
  SELECT *, 3 * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM weighted
), clamped AS (
  SELECT *, 4 * source_size * rest_w <= (budget - 2 * before) * w AS capped FROM sums
), level AS (
  SELECT CAST(3 * sum(source_size) - 2 * coalesce(sum(2 * source_size) FILTER (capped), 0) AS BIGINT) AS rest,
         CAST(coalesce(sum(w) FILTER (NOT capped), 1) AS BIGINT) AS weight FROM clamped
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(2 * weight AS DOUBLE) END AS target
  FROM clamped, level
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS UNBOUNDED PRECEDING) AS until
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, whole + CASE WHEN part > 0 AND until - size / 2 <= part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (shared.k IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (shared.k IS NULL OR doc_id = top), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id
"""

WARC = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""

TOPK = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _normal(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '[\x20\x09-\x0D]+', ' ', 'g')))"


QUOTES = rf"""
WITH RECURSIVE msgs AS (
  SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), own AS (
  SELECT conv_id, turn, role, array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{MARKS}')), chr(10)) AS own FROM msgs
), lines AS (
  SELECT conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM msgs
), depths AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS depth FROM lines
), starts AS (
  SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY conv_id, turn ORDER BY p) = depth THEN 0 ELSE 1 END AS start FROM depths
), runs AS (
  SELECT *, sum(start) OVER (PARTITION BY conv_id, turn ORDER BY p) AS run, {_normal(f"regexp_replace(line, '{MARKS}', '')")} AS body FROM starts
), passages AS (
  SELECT conv_id, turn, depth, run, {_normal("string_agg(body, ' ' ORDER BY p)")} AS whole, arg_max(body, (length(body), body)) AS longest
  FROM runs WHERE depth > 0 GROUP BY ALL
), units AS (
  SELECT conv_id, turn, unnest(list_concat([own], list_concat(regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10))))) AS u FROM own
), said AS (
  SELECT conv_id, {_normal("u")} AS u, min(turn) AS source FROM units GROUP BY ALL
), links AS (
  SELECT q.conv_id, q.turn, depth, coalesce(CASE WHEN a.source < q.turn THEN a.source END, CASE WHEN b.source < q.turn THEN b.source END) AS source
  FROM passages q LEFT JOIN said a ON a.conv_id = q.conv_id AND a.u = whole AND whole <> ''
  LEFT JOIN said b ON b.conv_id = q.conv_id AND b.u = longest AND longest <> ''
), replies AS (
  SELECT conv_id, turn, count(*) AS n_passages, count(source) AS n_linked, arg_max(source, (-depth, source)) FILTER (source IS NOT NULL) AS reply_to FROM links GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, reply_to AS thread FROM replies WHERE reply_to IS NOT NULL
  UNION SELECT c.conv_id, c.turn, r.reply_to FROM climb c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.thread WHERE r.reply_to IS NOT NULL
), threads AS (
  SELECT conv_id, turn, min(thread) AS thread FROM climb GROUP BY ALL
)
SELECT own.conv_id, coalesce(thread, own.turn) AS thread, own.turn, reply_to, role, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, own AS text
FROM own LEFT JOIN replies USING (conv_id, turn) LEFT JOIN threads USING (conv_id, turn)
"""

NEGATIVES = """
WITH rows AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.uid <> r.uid WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS slot FROM scored WHERE same QUALIFY slot <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.uid, p.slot ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.uid = p.uid AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
