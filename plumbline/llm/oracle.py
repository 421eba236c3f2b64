"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from plumbline.llm import mixing, resampling, spelling

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH hashed AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM hashed
WINDOW g AS (PARTITION BY text_sha256)
"""


def poisson_copies(table: str, seed: int = mixing.SEED, temperature: float = mixing.TEMPERATURE) -> str:
    """CTEs ending in `copied`: the rows of `table` with copies, copy and shuffle_key."""
    return f"""
counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}::DOUBLE) AS weight FROM {table} GROUP BY source),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts
),
terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30) + 1)::BIGINT)) AS k) ks
),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms),
drawn AS (
  SELECT *, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM {table}
),
counted AS (
  SELECT d.*, (SELECT count(*)::INT FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.upto <= d.u) AS copies
  FROM drawn d
),
copied AS (
  SELECT * EXCLUDE (u),
         ('0x' || substr(md5('shuffle {seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 15))::BIGINT AS shuffle_key
  FROM (SELECT c.*, unnest(range(1, c.copies + 1))::INT AS copy FROM counted c WHERE copies > 0)
)"""


OP9 = f"WITH {poisson_copies('documents')} SELECT * FROM copied"


# The table of the cyclic redundancy check, by its rule, as one list.
CRC_TABLE = """(
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i)
  FROM range(256) AS r(i)
)"""


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a column; needs `crc_table` with the list `t` beside it."""
    count = f"octet_length(encode({text}))"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(0, {count}), lambda i: {byte})"
    step = "xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce({bytes_}, lambda c, b: {step}, 4294967295), 4294967295)"


OP11 = f"""
WITH crc_table AS (SELECT {CRC_TABLE} AS t),
docs AS (SELECT row_number() OVER () AS row_key, * FROM documents),
raw AS (SELECT row_key, unnest(regexp_extract_all({LOWER}, '{resampling.WORD}')) AS word FROM docs),
wanted AS (SELECT unnest(regexp_extract_all({LOWER}, '{resampling.WORD}')) AS word FROM benchmark),
known AS (SELECT DISTINCT word FROM (SELECT word FROM raw UNION ALL SELECT word FROM wanted)),
bucketed AS (SELECT word, {crc32("word")} % {resampling.BUCKETS} AS bucket FROM known, crc_table),
s AS (SELECT bucket, count(*) AS s FROM raw JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN bucketed USING (word) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000.0::DOUBLE * ln(
    (coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM raw)::DOUBLE + {resampling.BUCKETS})
    / ((s::DOUBLE + 1) * ((SELECT count(*) FROM wanted)::DOUBLE + {resampling.BUCKETS}))
  ))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
weighed AS (
  SELECT row_key, count(*) AS n_features, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight
  FROM raw JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY row_key
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((
           ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE + 0.5
         ) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (row_key)
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {resampling.MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * n // 100 THEN place END AS rank FROM ranked
UNION ALL
SELECT *, NULL FROM scored WHERE n_features < {resampling.MIN_WORDS}
"""

# Near words meet where both give the same text by losing at most one code point.
OP12 = f"""
WITH RECURSIVE crc_table AS (SELECT {CRC_TABLE} AS t),
found AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') || ':' AS id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents
),
runs AS (SELECT id || run AS mark, run, count(*) AS n FROM found WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
drawn AS (SELECT run, n, {crc32("mark")} AS h FROM runs, crc_table),
changed AS (
  SELECT CASE WHEN h % {spelling.MODULUS} = 0
              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM drawn
),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {spelling.MIN_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
),
shorter AS (
  SELECT DISTINCT word, n, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS rest
  FROM (SELECT word, n, unnest(range(0, length(word) + 1))::INT AS i FROM words)
),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b USING (rest)
  WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
    AND (length(a.word) <> length(b.word)
         OR list_sum(list_transform(range(1, length(a.word) + 1), lambda i: (substr(a.word, i, 1) <> substr(b.word, i, 1))::INT)) = 1)
),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, row_number) AS other, max(other_n) AS other_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS row_number FROM near) GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other END AS form,
         CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
steps AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT s.word, s.next, f.form FROM steps s JOIN formed f ON f.word = s.next
)
SELECT f.*, s.root FROM formed f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""

_PLAIN = r"([\[<])(\\*)(INST\]|/INST\]|SYS\]|/SYS\]|s>|/s>|ROLE\]|/ROLE\]|/TURN\])"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '{_PLAIN}', '\1\\\2\3', 'g')"


OP13 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         length({_escaped("text")}) + CASE role
           WHEN 'system' THEN length('[SYS]  [/SYS]') WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('<s></s>')
           ELSE length('[ROLE]  [/ROLE] [/TURN]') + length({_escaped("role")}) END AS size
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, max(n)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


def sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op9_mixing": OP9, "op11_resampling": OP11, "op12_spelling": OP12, "op13_chat": OP13}
