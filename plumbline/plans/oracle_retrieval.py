"""SQL equivalents of the retrieval queries."""

from __future__ import annotations

from plumbline.functions.text import STOP_WORDS
from plumbline.operators.blockmax import BLOCK_ROWS, CLASS_STEP, FIRST_BLOCKS, SLACK
from plumbline.plans.oracle_catalog import COUNTS, DDL, FKS, PROFILE, QUESTIONS, SEARCH
from plumbline.plans.retrieval import DIM, TABLE_TOP_K, TABLE_TOTAL
from plumbline.plans.tables import TABLES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(name: str, source: str, key: str, text: str) -> str:
    """CTE of (id, term, tf, length)."""
    return f"""{name}_words AS (
  SELECT id, word FROM (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM {source})
  WHERE word <> '' AND word NOT IN ({_STOP})),
{name} AS (
  SELECT id, term, count(*) AS tf, CAST(max(length) AS INTEGER) AS length FROM (
    SELECT id, CASE WHEN regexp_matches(word, 'ies$') AND NOT regexp_matches(word, '[ea]ies$') THEN regexp_replace(word, 'ies$', 'y')
                    WHEN regexp_matches(word, 'es$') AND NOT regexp_matches(word, '[aeo]es$') THEN regexp_replace(word, 's$', '')
                    WHEN regexp_matches(word, 's$') AND NOT regexp_matches(word, '[us]s$') THEN regexp_replace(word, 's$', '')
                    ELSE word END AS term, count(*) OVER (PARTITION BY id) AS length FROM {name}_words)
  GROUP BY id, term)"""


def bm25(name: str, questions: str, items: str) -> str:
    """CTE of (question_id, id, score, rank)."""
    return f"""{name}_n AS (SELECT count(DISTINCT id) AS n, sum(tf) / count(DISTINCT id)::DOUBLE AS mean_length FROM {items}),
{name}_df AS (SELECT term, count(*) AS df FROM {items} GROUP BY 1),
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
    SELECT q.id AS question_id, p.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE
             / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / mean_length))), 9) AS score
    FROM {questions} q JOIN {items} p USING (term) JOIN {name}_df USING (term), {name}_n GROUP BY 1, 2)
  QUALIFY rank <= 30)"""


def block_report(questions: str, items: str) -> str:
    """CTEs ending in `judged`: every block of texts that holds a term of a question, and whether it must be opened."""
    idf = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    weight = "p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / mean_length))"
    return f"""lengths AS (SELECT id, floor(sqrt(max(length)))::BIGINT AS class FROM {items} GROUP BY id),
placed AS (
  SELECT id, class * {CLASS_STEP} + ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % n_parts AS block
  FROM lengths JOIN (SELECT class, ceil(count(*) / {BLOCK_ROWS}::DOUBLE)::BIGINT AS n_parts FROM lengths GROUP BY 1) USING (class)),
totals AS (SELECT count(DISTINCT id) AS n, sum(tf) / count(DISTINCT id)::DOUBLE AS mean_length FROM {items}),
known AS (SELECT term, count(*) AS df FROM {items} GROUP BY 1),
shares AS (
  SELECT q.id AS question_id, p.id, block, term, {idf} AS idf, {weight} AS weight
  FROM {questions} q JOIN {items} p USING (term) JOIN known USING (term) JOIN placed ON placed.id = p.id, totals),
bounds AS (
  SELECT *, row_number() OVER best AS nth, coalesce(sum(sure) OVER (best ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT question_id, block, sum(idf * peak) AS bound, max(held) AS sure
    FROM (SELECT question_id, block, term, idf, max(weight) AS peak, count(*) AS held FROM shares GROUP BY ALL) GROUP BY 1, 2)
  WINDOW best AS (PARTITION BY question_id ORDER BY round(bound, 9) DESC, block)),
scored AS (SELECT question_id, block, id, round(sum(idf * weight), 9) AS score FROM shares GROUP BY 1, 2, 3),
thresholds AS (
  SELECT question_id, score AS least FROM scored JOIN bounds USING (question_id, block) WHERE nth <= {FIRST_BLOCKS} OR before < 30
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) = 30),
judged AS (
  SELECT b.*, nth <= {FIRST_BLOCKS} OR before < 30 AS is_first,
         NOT (nth <= {FIRST_BLOCKS} OR before < 30) AND coalesce(bound + {SLACK} < least, false) AS skipped
  FROM bounds b LEFT JOIN thresholds USING (question_id))"""


def cosine(name: str, pairs: str) -> str:
    return f"""{name} AS (
  SELECT question_id, id, dist, CAST(row_number() OVER (PARTITION BY question_id ORDER BY dist, id) AS INTEGER) AS rank
  FROM ({pairs}) QUALIFY rank <= 30)"""


def buckets(name: str, terms: str) -> str:
    return f"""{name} AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS INTEGER) AS bucket, sum(tf) AS tf FROM {terms} GROUP BY 1, 2)"""


def idf(name: str, hashed: str) -> str:
    return f"""{name} AS (SELECT bucket, ln(((SELECT count(DISTINCT id) FROM {hashed}) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM {hashed} GROUP BY bucket)"""


def weights(name: str, hashed: str, idf_name: str) -> str:
    return f"""{name} AS (
  SELECT id, bucket, w / norm AS w FROM (
    SELECT id, bucket, tf * coalesce(idf, 0) AS w, sqrt(sum((tf * coalesce(idf, 0)) ** 2) OVER (PARTITION BY id)) AS norm
    FROM {hashed} LEFT JOIN {idf_name} USING (bucket)))"""


RRF = """rrf AS (
  SELECT question_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score,
         max(rank) FILTER (WHERE s = 'dense') AS dense_rank, max(rank) FILTER (WHERE s = 'lexical') AS lexical_rank
  FROM (SELECT question_id, id, rank, 'dense' AS s FROM dense UNION ALL SELECT question_id, id, rank, 'lexical' FROM lexical)
  GROUP BY 1, 2)"""


def fused(top_k: int) -> str:
    return f"""hits AS (
  SELECT question_id, id, score, dense_rank, lexical_rank,
         CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST) AS INTEGER) AS pos
  FROM rrf QUALIFY pos <= {top_k})"""


DOC_TOKENS = tokens("items", "documents", "doc_id", "text")
DOC_ASKED = tokens("asked", "benchmark", "item_id", "text")
DOC_LEXICAL = f"{DOC_TOKENS}, {DOC_ASKED}, {bm25('lexical', 'asked', 'items')}"
_DISTANCE = "round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 AS dist"
ALL_DENSE = cosine("dense", f"SELECT a.vec_id AS question_id, b.vec_id AS id, {_DISTANCE} FROM embeddings a, embeddings b")
DOC_DENSE = cosine(
    "dense",
    f"""SELECT a.vec_id AS question_id, b.vec_id AS id, {_DISTANCE} FROM embeddings a, embeddings b
    WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM documents)""",
)

TABLE_VECTORS = f"""{tokens('items', 'table_corpus', 'id', 'text')}, {tokens('asked', 'table_questions', 'question_id', 'question')},
{buckets('item_buckets', 'items')}, {buckets('asked_buckets', 'asked')}, {idf('idf', 'item_buckets')},
{weights('item_weights', 'item_buckets', 'idf')}, {weights('asked_weights', 'asked_buckets', 'idf')}"""
TABLE_DENSE = cosine(
    "dense",
    """SELECT q.question_id, i.id, round(1 - coalesce(dot, 0), 9) + 0.0 AS dist
    FROM table_questions q CROSS JOIN table_corpus i LEFT JOIN (
      SELECT a.id AS question_id, b.id, sum(a.w * b.w) AS dot FROM asked_weights a JOIN item_weights b USING (bucket) GROUP BY 1, 2) d
    ON d.question_id = q.question_id AND d.id = i.id""",
)
TABLE_HITS = f"""{PROFILE}, {SEARCH}, {QUESTIONS}, {TABLE_VECTORS}, {TABLE_DENSE}, {bm25('lexical', 'asked', 'items')},
{RRF}, {fused(TABLE_TOP_K)}"""

EDGES = """edges AS (SELECT "table" AS src, references_table AS dst FROM fks UNION SELECT references_table, "table" FROM fks)"""

EXPANDED = f"""{EDGES}, added AS (
  SELECT h.question_id, dst AS id, min(h.pos) AS from_pos FROM hits h JOIN edges ON h.id = src
  WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.question_id = h.question_id AND x.id = dst) GROUP BY 1, 2),
expanded AS (
  SELECT question_id, id, score, dense_rank, lexical_rank, pos FROM hits
  UNION ALL
  SELECT question_id, id, 0.0, NULL, NULL, pos FROM (
    SELECT question_id, id, CAST((SELECT count(*) FROM hits h WHERE h.question_id = a.question_id)
             + row_number() OVER (PARTITION BY question_id ORDER BY from_pos, id) AS INTEGER) AS pos FROM added a)
  WHERE pos <= {TABLE_TOTAL})"""

SELECTED = f"""{TABLE_HITS}, {EXPANDED}, selected AS (SELECT question_id, id AS "table", pos FROM expanded)"""
SCHEMAS = """schemas AS (
  SELECT question_id, string_agg(ddl, chr(10) || chr(10) ORDER BY pos) AS schema_text, CAST(count(*) AS INTEGER) AS n_tables
  FROM selected s JOIN ddl d ON s."table" = d."table" GROUP BY 1)"""
_SCHEMA_COLUMNS = "question_id, md5(schema_text) AS schema_md5, CAST(length(schema_text) // 4 AS INTEGER) AS est_tokens, n_tables"
RECALL = """recalls AS (
  SELECT question_id, count(*) AS n_gold, round(count(s."table") / count(*)::DOUBLE, 6) AS recall
  FROM (SELECT question_id, unnest(gold) AS "table" FROM table_questions) g LEFT JOIN selected s USING (question_id, "table") GROUP BY 1)"""


def sql() -> dict[str, str]:
    names = ", ".join(f"'{t}'" for t in TABLES)
    return {
        "text_vectors": f"""WITH {DOC_TOKENS}, {buckets('hashed', 'items')}, {idf('idf', 'hashed')}, {weights('weights', 'hashed', 'idf')}
SELECT id, bucket, round(w, 6) AS weight FROM weights WHERE round(w, 6) <> 0""",
        "dense_topk": f"WITH {ALL_DENSE} SELECT question_id, id, round(dist, 6) + 0.0 AS dist, rank FROM dense",
        "dense_topk_blocked": f"WITH {ALL_DENSE} SELECT question_id, id, round(dist, 6) + 0.0 AS dist, rank FROM dense",
        "tokenize": f"WITH {DOC_TOKENS} SELECT * FROM items",
        "postings": f"WITH {DOC_TOKENS} SELECT term, count(*) AS df FROM items GROUP BY term",
        "doc_stats": f"WITH {DOC_TOKENS} SELECT id, max(length) AS length, count(*) AS n_terms FROM items GROUP BY id",
        "lexical_topk": f"WITH {DOC_LEXICAL} SELECT question_id, id, round(score, 6) AS score, rank FROM lexical",
        "block_topk": f"WITH {DOC_LEXICAL} SELECT question_id, id, round(score, 6) AS score, rank FROM lexical",
        "block_report": f"""WITH {DOC_TOKENS}, {DOC_ASKED}, {block_report('asked', 'items')}
SELECT question_id, count(*) AS n_blocks, count(*) FILTER (WHERE is_first) AS n_first,
  count(*) FILTER (WHERE NOT is_first AND NOT skipped) AS n_opened, count(*) FILTER (WHERE skipped) AS n_skipped
FROM judged GROUP BY question_id""",
        "rrf": f"WITH {DOC_LEXICAL}, {DOC_DENSE}, {RRF} SELECT question_id, id, round(score, 9) AS score, dense_rank, lexical_rank FROM rrf",
        "hybrid_topk": f"WITH {DOC_LEXICAL}, {DOC_DENSE}, {RRF}, {fused(10)} SELECT question_id, id, round(score, 9) AS score, dense_rank, lexical_rank, pos FROM hits",
        "fk_edges": f"""WITH {FKS}, {COUNTS}, {EDGES} SELECT src, dst, s.n_rows AS src_rows, d.n_rows AS dst_rows
FROM edges JOIN counts s ON s."table" = src JOIN counts d ON d."table" = dst""",
        "table_hits": f"WITH {TABLE_HITS} SELECT question_id, id, round(score, 9) AS score, dense_rank, lexical_rank, pos FROM hits",
        "expand_fk": f"WITH {TABLE_HITS}, {EXPANDED} SELECT question_id, id, round(score, 9) AS score, dense_rank, lexical_rank, pos FROM expanded",
        "select_tables_baseline": f"""SELECT c_custkey AS question_id, t AS "table", CAST(p AS INTEGER) AS pos
FROM customer, (SELECT unnest(list_sort([{names}])) AS t, generate_subscripts([{names}], 1) AS p)""",
        "select_tables": f"WITH {SELECTED} SELECT * FROM selected",
        "retrieval_recall": f"WITH {SELECTED}, {RECALL} SELECT * FROM recalls",
        "mean_recall": f"WITH {SELECTED}, {RECALL} SELECT count(*) AS questions, round(avg(recall), 6) AS mean_recall FROM recalls",
        "render_schema": f"WITH {SELECTED}, {DDL}, {SCHEMAS} SELECT {_SCHEMA_COLUMNS} FROM schemas",
        "build_prompt": f"""WITH {SELECTED}, {DDL}, {SCHEMAS}, prompts AS (
  SELECT question_id, 'Schéma :' || chr(10) || chr(10) || schema_text || chr(10) || chr(10)
    || CASE WHEN evidence <> '' THEN 'Indication : ' || evidence || chr(10) || chr(10) ELSE '' END
    || 'Question : ' || question || chr(10) || chr(10) || 'Requête SQL :' AS prompt
  FROM table_questions JOIN schemas USING (question_id))
SELECT question_id, md5(prompt) AS prompt_md5, CAST(length(prompt) // 4 AS INTEGER) AS est_tokens FROM prompts""",
    }
