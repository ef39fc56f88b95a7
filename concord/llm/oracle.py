"""DuckDB SQL for the queries that SQL can express."""

_CRC32 = """
crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The op2 columns of every row of {docs}, trusted documents being those of quality 1.
_LLR = _CRC32 + rf"""
rows_ AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
w AS (SELECT rid, doc_id, text, {_WORDS} AS w FROM rows_),
occ AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(strlen(word)), lambda k: ('0x' || substr(hex(word), 2 * k + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS c
  FROM (SELECT DISTINCT word FROM occ), crc_table),
placed AS (SELECT rid, i, word, c, lead(c) OVER (PARTITION BY rid ORDER BY i) AS c2,
    word || ' ' || lead(word) OVER (PARTITION BY rid ORDER BY i) || ' '
      || lead(word, 2) OVER (PARTITION BY rid ORDER BY i) AS win
  FROM occ JOIN hashed USING (word)),
grams AS (SELECT rid, c % 65536 AS bucket FROM placed
  UNION ALL SELECT rid, (31 * c + c2) % 65536 FROM placed WHERE c2 IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT bucket, count(*) AS r, count(t.doc_id) AS t
  FROM grams JOIN rows_ USING (rid) LEFT JOIN trusted t USING (doc_id) GROUP BY bucket),
totals AS (SELECT sum(t) / greatest(sum(r), 1) AS f FROM counts),
weights AS (SELECT bucket, round(ln((t + 16) / (r * f + 16)) * 1000000)::BIGINT AS weight FROM counts, totals),
scores AS (SELECT rid, sum(weight) AS total, count(*) AS n FROM grams JOIN weights USING (bucket) GROUP BY rid),
rep AS (SELECT rid, i FROM placed WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM rep, range(3) o(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rows_)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (SELECT rid, w.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(n_repeat, 0) > 50 * len(w) AS base_failed,
    coalesce(total / n / 1000000, 0.0) AS llr, coalesce(total, 0) >= -80000 * coalesce(n, 0) AS likely
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN scores USING (rid))
"""

OP2 = "WITH " + _LLR.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr,
  NOT base_failed AND likely AS kept FROM base
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                                  (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(er) + length(et) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = "WITH RECURSIVE " + _CRC32 + r"""
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keys AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(strlen(k)), lambda j: ('0x' || substr(hex(k), 2 * j + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS d
  FROM (SELECT DISTINCT k FROM src), crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN d = 0 THEN [] WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src JOIN keys USING (k)),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM numbered),
faults AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS two FROM ordered),
insertions(q, q1, fee, letters, lines) AS (VALUES
  ('', '', 0, '', ''), ('', 'u', 3, 'I', '\nuser:'), ('', 'a', 6, 'II', '\nuser:\nassistant:'),
  ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', '\nuser:'), ('s', 'a', 6, 'II', '\nuser:\nassistant:'),
  ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', '\nassistant:'), ('u', 'u', 6, 'II', '\nassistant:\nuser:'),
  ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', '\nuser:'), ('a', 'a', 6, 'II', '\nuser:\nassistant:')),
edits(q1, ini, q2, fee2, letter, who) AS (VALUES
  ('', 's', 's', 0, 'K', NULL), ('', 'u', 'u', 0, 'K', NULL), ('s', 'u', 'u', 0, 'K', NULL), ('u', 'a', 'a', 0, 'K', NULL), ('a', 'u', 'u', 0, 'K', NULL),
  ('', NULL, 'u', 3, 'R', 'user'), ('s', NULL, 'u', 3, 'R', 'user'), ('u', NULL, 'a', 3, 'R', 'assistant'), ('a', NULL, 'u', 3, 'R', 'user'),
  ('', NULL, '', 4, 'D', NULL), ('s', NULL, 's', 4, 'D', NULL), ('u', NULL, 'u', 4, 'D', NULL), ('a', NULL, 'a', 4, 'D', NULL)),
paths AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '' AS q, 0 AS cost, '' AS audit, '' AS lines FROM faults
  UNION ALL
  SELECT c, i, q, cost, audit, lines FROM (
    SELECT f.c, f.i, e.q2 AS q, p.cost + n.fee + e.fee2 + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost,
      p.audit || n.letters || e.letter AS audit,
      p.lines || replace(n.lines, '\n', chr(10)) || CASE WHEN e.letter = 'D' THEN '' ELSE chr(10) || coalesce(e.who, f.role) || ':' || f.text END AS lines
    FROM paths p JOIN faults f ON f.c = p.c AND f.i = p.i + 1 JOIN insertions n ON n.q = p.q
      JOIN edits e ON e.q1 = n.q1 AND (e.ini IS NULL OR e.ini = f.ini) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) = 1),
ends AS (SELECT p.c, p.cost + n.fee AS cost, p.audit || n.letters AS audit, p.lines || replace(n.lines, '\n', chr(10)) AS lines
  FROM paths p JOIN insertions n USING (q) WHERE n.q1 IN ('a', '') AND p.i = (SELECT max(i) FROM faults f WHERE f.c = p.c)
  QUALIFY row_number() OVER (PARTITION BY p.c ORDER BY p.cost + n.fee, p.audit || n.letters) = 1),
counts AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ends USING (c)
"""

OP12 = "WITH " + _CRC32 + r"""
low(side, rid, doc_id, w) AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
    UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark)),
occ AS (SELECT side, rid, unnest(w) AS word FROM low),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(strlen(word)), lambda k: ('0x' || substr(hex(word), 2 * k + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM occ), crc_table),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM occ JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS gain FROM n),
weighed AS (SELECT rid, floor(sum(gain) / count(*))::BIGINT AS weight FROM occ JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY rid),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM low LEFT JOIN weighed USING (rid) WHERE side = 's'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
