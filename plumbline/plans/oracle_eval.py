"""SQL equivalents of the evaluation queries, for checking against DuckDB."""

from __future__ import annotations

RUNS = "runs(tag, shift, tables) AS (VALUES ('baseline', 0, 14), ('agent', 2, 10))"

QUESTIONS = """questions AS (
  SELECT o_orderkey AS question_id, 'sales' AS db_id,
         'Which lines has order ' || o_orderkey || '?' AS question,
         CASE WHEN o_orderkey % 2 = 0 THEN 'status is ' || o_orderstatus ELSE '' END AS evidence,
         'SELECT l_linenumber, CAST(SUM(l_quantity) AS BIGINT), CASE WHEN SUM(l_quantity) < 25 THEN ''small'' ELSE ''large'' END FROM lineitem WHERE l_orderkey = '
           || o_orderkey || ' GROUP BY l_linenumber ORDER BY l_linenumber' AS gold_sql,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'challenging' WHEN '2' THEN 'moderate'
              WHEN '3' THEN 'moderate' ELSE 'simple' END AS difficulty
  FROM orders)"""

PREDICTIONS = f"""{RUNS}, {QUESTIONS}, predictions AS (
  SELECT tag, question_id, db_id, difficulty, question, evidence,
         CASE WHEN (question_id + shift) % 17 = 0 THEN 'SELECT 1 / 0' ELSE gold_sql END AS predicted_sql,
         CASE WHEN (question_id + shift) % 17 = 0 THEN 'division by zero' END AS execution_error,
         gold_sql,
         CASE WHEN question_id % 101 = 0 THEN 'statement timeout' END AS gold_error,
         CAST(2000 + question_id % 700 + 7 * shift AS INTEGER) AS prompt_tokens,
         CAST(100 + question_id % 90 AS INTEGER) AS completion_tokens,
         (question_id % 3000) / 1000.0::DOUBLE AS latency_s,
         CAST(CASE WHEN shift > 0 THEN question_id % 4 ELSE 0 END AS INTEGER) AS attempts,
         (question_id + shift) % 17 = 0 AS pred_is_null,
         question_id % 101 = 0 AS gold_is_null
  FROM questions, runs)"""

# Rows are kept as text: 'D:1|D:17|S:A'; every cell holds neither '|' nor ','.
CELLS = """lines AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, CAST(sum(l_quantity) AS BIGINT) AS q, CASE WHEN sum(l_quantity) < 25 THEN 'small' ELSE 'large' END AS f
  FROM lineitem GROUP BY ALL),
shifted AS (SELECT *, (k + shift) % 7 AS c, 'D:' || ln AS cn, 'D:' || q AS cq, 'S:' || f AS cf FROM lines, runs),
result_cells AS (
  SELECT tag, k AS question_id, 'gold' AS side, CAST(ln AS BIGINT) AS pos, [cn, cq, cf] AS cells
  FROM shifted WHERE k % 101 <> 0
  UNION ALL
  SELECT tag, k, 'pred', CASE c WHEN 1 THEN 1000 - ln WHEN 5 THEN 2 * ln ELSE ln END,
         CASE c WHEN 3 THEN [cq, cn, cf] WHEN 4 THEN [cn, 'D:' || (q + 1), cf] ELSE [cn, cq, cf] END
  FROM shifted WHERE (k + shift) % 17 <> 0 AND NOT (c = 2 AND ln = 1)
  UNION ALL
  SELECT tag, k, 'pred', 2 * ln + 1, [cn, cq, cf] FROM shifted WHERE (k + shift) % 17 <> 0 AND c = 5
  UNION ALL
  SELECT tag, k, 'pred', ln + 500, [cn, 'N', 'N'] FROM shifted WHERE (k + shift) % 17 <> 0 AND c = 6 AND ln = 1)"""


def half_even(value: str, digits: int) -> str:
    """Half-even rounding by the exact binary value of a non-negative double."""
    twice = f"{2.0 * 10**digits}::DOUBLE"
    scale = f"{float(10**digits)}::DOUBLE"
    v = f"({value})::DOUBLE"
    step = f"round_even({v} * {twice}, 0)::DOUBLE"
    high = f"({v})::FLOAT::DOUBLE"
    dist = f"(({step} - {high} * {twice}) - ({v} - {high}) * {twice})"
    tie = f"({step} % 2 = 1 AND {v} = {step} / {twice})"
    return (
        f"CASE WHEN {tie} AND {dist} > 0 THEN ({step} - 1) / 2 / {scale} "
        f"WHEN {tie} AND {dist} < 0 THEN ({step} + 1) / 2 / {scale} "
        f"ELSE round_even({v}, {digits})::DOUBLE END"
    )


LOG = f"WITH {PREDICTIONS}, {CELLS}"

DEDUPED = """deduped AS (
  SELECT tag, question_id, side, cells, row_number() OVER (PARTITION BY tag, question_id, side ORDER BY p) - 1 AS pos
  FROM (SELECT tag, question_id, side, cells, min(pos) AS p FROM result_cells GROUP BY ALL))"""

MATCHES = """matches AS (
  SELECT p.tag, p.question_id,
         NOT pred_is_null AND NOT gold_is_null AND coalesce(d.n, 0) = 0 AS correct
  FROM predictions p LEFT JOIN (
    SELECT tag, question_id, count(*) AS n FROM (
      SELECT tag, question_id, cells FROM result_cells GROUP BY ALL HAVING count(DISTINCT side) = 1)
    GROUP BY ALL) d USING (tag, question_id))"""

PAIRS = """pairs AS (
  SELECT tag, question_id, pos, p.cells AS pred, g.cells AS gold
  FROM (SELECT * FROM deduped WHERE side = 'pred') p
  FULL JOIN (SELECT * FROM deduped WHERE side = 'gold') g USING (tag, question_id, pos))"""

SIMILARITY = """similarity AS (
  SELECT tag, question_id, pos, pred, gold,
         len(list_filter(pred, lambda x: list_contains(gold, x))) / len(gold)::DOUBLE AS matches,
         len(list_filter(pred, lambda x: NOT list_contains(gold, x))) / len(gold)::DOUBLE AS pred_only,
         len(list_filter(gold, lambda x: NOT list_contains(pred, x))) / len(gold)::DOUBLE AS gold_only
  FROM pairs)"""

F1 = """sums AS (
  SELECT tag, question_id, sum(coalesce(matches, 0)) AS tp,
         sum(CASE WHEN gold IS NULL THEN 1 ELSE coalesce(pred_only, 0) END) AS fp,
         sum(CASE WHEN pred IS NULL THEN 1 ELSE coalesce(gold_only, 0) END) AS fn
  FROM similarity GROUP BY ALL),
f1 AS (
  SELECT p.tag, p.question_id,
         CASE WHEN s.tp IS NULL THEN 1.0
              WHEN pred_is_null OR gold_is_null OR s.tp = 0 THEN 0.0
              ELSE 2 * (s.tp / (s.tp + s.fp)) * (s.tp / (s.tp + s.fn))
                   / (s.tp / (s.tp + s.fp) + s.tp / (s.tp + s.fn)) END::DOUBLE AS soft_f1
  FROM predictions p LEFT JOIN sums s USING (tag, question_id))"""

SCORED = f"{LOG}, {DEDUPED}, {MATCHES}, {PAIRS}, {SIMILARITY}, {F1}"

RESULTS = f"""{SCORED}, results AS (
  SELECT tag, question_id, db_id, difficulty,
         coalesce(gold_error, '') = '' AND correct AS correct,
         CASE WHEN coalesce(gold_error, '') = '' THEN {half_even('soft_f1', 4)} ELSE 0.0 END::DOUBLE AS soft_f1,
         CASE WHEN coalesce(gold_error, '') = '' AND correct THEN 'correct'
              WHEN coalesce(gold_error, '') <> '' THEN 'gold_failed'
              WHEN coalesce(execution_error, '') <> '' THEN 'sql_error'
              ELSE 'wrong_result' END AS category,
         execution_error IS NULL AS executed, prompt_tokens, completion_tokens, latency_s
  FROM predictions JOIN matches USING (tag, question_id) JOIN f1 USING (tag, question_id))"""

SUMMARY = f"""{RESULTS}, summary AS (
  SELECT tag, count(*) AS questions,
         {half_even('count(*) FILTER (WHERE correct) / count(*)::DOUBLE', 4)} AS execution_accuracy,
         {half_even('sum(soft_f1::DECIMAL(20,4))::DOUBLE / count(*)::DOUBLE', 4)} AS soft_f1,
         {half_even('count(*) FILTER (WHERE executed) / count(*)::DOUBLE', 4)} AS valid_sql_rate,
         count(*) FILTER (WHERE executed) AS executed_ok,
         {half_even('sum(latency_s::DECIMAL(20,9))::DOUBLE / count(*)::DOUBLE', 3)} AS latency_mean_s
  FROM results GROUP BY tag)"""

TOKENS = """tokens AS (
  SELECT tag, sum(prompt_tokens)::BIGINT AS prompt_total, sum(completion_tokens)::BIGINT AS completion_total,
         (sum(prompt_tokens) + sum(completion_tokens))::BIGINT AS total,
         round_even(sum(prompt_tokens)::DOUBLE / count(*), 0)::BIGINT AS prompt_per_question,
         round_even(sum(completion_tokens)::DOUBLE / count(*), 0)::BIGINT AS completion_per_question
  FROM results GROUP BY tag)"""


def _decimal_text(value: str, digits: int) -> str:
    fixed = f"regexp_replace(CAST({value} AS DECIMAL(18,{digits}))::VARCHAR, '0+$', '')"
    return rf"regexp_replace({fixed}, '\.$', '.0')"


def _difficulty(group: str, select: str) -> str:
    return f"""SELECT tag, {select} AS difficulty, count(*) AS total,
       count(*) FILTER (WHERE correct) AS correct,
       {half_even('count(*) FILTER (WHERE correct) / count(*)::DOUBLE', 4)} AS execution_accuracy,
       {half_even('sum(soft_f1::DECIMAL(20,4))::DOUBLE / count(*)::DOUBLE', 4)} AS soft_f1
FROM results GROUP BY {group}"""


def _sample(n: int) -> str:
    return f"""WITH {QUESTIONS},
hashed AS (SELECT *, md5('42:' || question_id) AS d FROM questions),
sizes AS (SELECT difficulty, CAST(floor({n} * count(*) / (SELECT count(*) FROM questions)) AS BIGINT) AS share
          FROM questions GROUP BY 1),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY difficulty ORDER BY d, question_id) AS r FROM hashed h),
picked AS (SELECT r.* FROM ranked r JOIN sizes USING (difficulty) WHERE r <= share),
rest AS (SELECT *, row_number() OVER (ORDER BY d, question_id) AS r2 FROM ranked
         WHERE question_id NOT IN (SELECT question_id FROM picked))
SELECT question_id, difficulty FROM picked
UNION ALL
SELECT question_id, difficulty FROM rest
WHERE r2 <= least({n}, (SELECT count(*) FROM questions)) - (SELECT count(*) FROM picked)"""


ATTEMPTS = f"""{PREDICTIONS}, attempts AS (
  SELECT question_id, CAST(a AS INTEGER) AS attempt_no,
         'SELECT ' || a || ' AS try_' || question_id AS sql,
         CASE WHEN question_id % 13 = 0 THEN ['opération interdite : DELETE']
              WHEN a < attempts AND a % 2 = 0 THEN ['la table orderz n''existe pas', 'la colonne total n''appartient à aucune table de la requête']
              ELSE []::VARCHAR[] END AS validation_errors,
         question_id % 13 = 0 AS blocked,
         CASE WHEN question_id % 13 <> 0 AND (a < attempts AND a % 2 = 1 OR attempts = 3 AND a = 3) THEN 'division by zero' END AS execution_error,
         prompt_tokens, completion_tokens, latency_s
  FROM (SELECT * FROM predictions WHERE tag = 'agent'), unnest(range(0, CASE WHEN question_id % 13 = 0 THEN 1 ELSE attempts + 1 END)) AS t(a))"""


def sql() -> dict[str, str]:
    queries = {
        "derived_predictions": f"WITH {PREDICTIONS} SELECT * FROM predictions",
        "derived_result_cells": f"{LOG} SELECT tag, question_id, side, pos, array_to_string(cells, '|') AS row_text FROM result_cells",
        "execution_match": f"{LOG}, {MATCHES} SELECT * FROM matches",
        "dedupe_rows": f"{LOG}, {DEDUPED} SELECT tag, question_id, side, array_to_string(cells, '|') AS row_text, pos FROM deduped",
        "row_similarity": f"""{LOG}, {DEDUPED}, {PAIRS}, {SIMILARITY}
SELECT tag, question_id, pos, matches, pred_only, gold_only FROM similarity
WHERE pred IS NOT NULL AND gold IS NOT NULL""",
        "soft_f1": f"{SCORED} SELECT tag, question_id, round(soft_f1, 9) AS soft_f1 FROM f1",
        "categorize": f"{RESULTS} SELECT tag, category, count(*) AS n FROM results GROUP BY ALL",
        "evaluate_questions": f"{RESULTS} SELECT * FROM results",
        "summary": f"{SUMMARY} SELECT * FROM summary",
        "breakdown": f"""{RESULTS} SELECT tag, count(*) FILTER (WHERE category = 'correct') AS correct,
  count(*) FILTER (WHERE category = 'wrong_result') AS wrong_result,
  count(*) FILTER (WHERE category = 'sql_error') AS sql_error,
  count(*) FILTER (WHERE category = 'gold_failed') AS gold_failed FROM results GROUP BY tag""",
        "by_difficulty": f"{RESULTS} {_difficulty('tag, difficulty', 'difficulty')}",
        "by_difficulty_with_total": f"{RESULTS} {_difficulty('tag, difficulty', 'difficulty')} UNION ALL {_difficulty('tag', chr(39) + 'all' + chr(39))}",
        "token_usage": f"{RESULTS}, {TOKENS} SELECT * FROM tokens",
        "eval_invariants": f"""{RESULTS} SELECT tag, count(*) AS questions,
  count(*) FILTER (WHERE category NOT IN ('correct', 'wrong_result', 'sql_error', 'gold_failed')) AS uncategorised,
  count(*) FILTER (WHERE correct AND NOT executed) AS correct_not_executed FROM results GROUP BY tag""",
        "compare_runs": f"""{SUMMARY}, {TOKENS} SELECT tag,
  '| ' || tag || ' | model-a | ' || tables || ' | **' || {_decimal_text('execution_accuracy', 4)} || '** | '
  || {_decimal_text('soft_f1', 4)} || ' | ' || prompt_per_question || ' | ' || {_decimal_text('latency_mean_s', 3)} || 's |' AS line
FROM summary JOIN tokens USING (tag) JOIN runs USING (tag)""",
        "latest_runs": """SELECT tag, generated_at, path FROM (
  SELECT o_orderstatus AS tag, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS generated_at,
         'reports/' || o_orderstatus || '/evaluation-' || o_orderkey || '.json' AS path FROM orders)
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY generated_at DESC, path) = 1""",
        "same_questions_check": """SELECT doc_id AS question_id, 'labels' AS missing_from FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'documents' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
        "metric_drift": f"""{SUMMARY}, long AS (
  UNPIVOT (SELECT tag, questions::DOUBLE AS questions, execution_accuracy, soft_f1, valid_sql_rate,
                  executed_ok::DOUBLE AS executed_ok, latency_mean_s FROM summary)
  ON COLUMNS(* EXCLUDE tag) INTO NAME metric VALUE value)
SELECT 'agent' AS tag, b.metric, b.value AS expected, a.value AS actual
FROM (SELECT * FROM long WHERE tag = 'baseline') b JOIN (SELECT * FROM long WHERE tag = 'agent') a USING (metric)
WHERE b.value IS DISTINCT FROM a.value""",
        "freeze_fixture": f"""{LOG}, chosen AS (
  SELECT tag, question_id FROM predictions QUALIFY row_number() OVER (PARTITION BY tag ORDER BY question_id) <= 50)
SELECT tag, question_id, side, pos, array_to_string(cells, '|') AS row_text
FROM result_cells JOIN chosen USING (tag, question_id)
QUALIFY row_number() OVER (PARTITION BY tag, question_id, side ORDER BY pos) <= 20""",
        "stratified_sample": _sample(500),
        "attempt_rollup": f"""WITH {ATTEMPTS}
SELECT question_id, arg_max(sql, attempt_no) AS sql,
  CASE WHEN arg_max(coalesce(execution_error, ''), attempt_no) <> '' THEN arg_max(coalesce(execution_error, ''), attempt_no)
       WHEN arg_max(len(validation_errors), attempt_no) > 0
       THEN 'VALIDATION: ' || arg_max(array_to_string(validation_errors, '; '), attempt_no) END AS error,
  max(attempt_no) AS repairs, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  round_even(sum(latency_s), 3)::DOUBLE AS latency_s,
  string_agg(sql, ' ; ' ORDER BY attempt_no) AS history,
  CASE WHEN arg_max(coalesce(execution_error, ''), attempt_no) = '' AND arg_max(len(validation_errors), attempt_no) = 0 THEN 'done'
       WHEN arg_max(blocked, attempt_no) THEN 'blocked' WHEN max(attempt_no) >= 3 THEN 'exhausted' ELSE 'open' END AS end_state
FROM attempts GROUP BY question_id""",
        "failure_counts": f"""WITH {PREDICTIONS} SELECT tag, count(*) AS questions,
  count(*) FILTER (WHERE execution_error <> '') AS failed, count(*) FILTER (WHERE attempts > 0) AS repaired,
  sum(attempts)::BIGINT AS repairs FROM predictions GROUP BY tag""",
        "running_failures": f"""WITH {PREDICTIONS} SELECT tag, question_id,
  count(*) OVER w AS done, sum((coalesce(execution_error, '') <> '')::BIGINT) OVER w::BIGINT AS failed,
  sum((attempts > 0)::BIGINT) OVER w::BIGINT AS repaired FROM predictions
WINDOW w AS (PARTITION BY tag ORDER BY question_id ROWS UNBOUNDED PRECEDING)""",
    }
    return queries
