"""SQL equivalents of the file, query log and workload queries."""

from __future__ import annotations

from plumbline.plans import workload
from plumbline.plans.oracle_catalog import COUNTS
from plumbline.plans.oracle_eval import LOG, PREDICTIONS, QUESTIONS, RESULTS, RUNS, SUMMARY, TOKENS, _decimal_text, _difficulty

_DESCRIPTIONS = """descriptions AS (
  SELECT "table", 'Stores ' || "table" || ' records, ' || n_rows || ' in number.' AS description FROM counts WHERE n_rows > 5)"""


# Two runs of every tag; the tag carries the stamp.
_EVERY_RUN = """runs(tag, shift, tables) AS (VALUES ('baseline 20240101-000000', 0, 14), ('agent 20240101-000000', 2, 10),
  ('baseline 20240301-120000', 5, 14), ('agent 20240301-120000', 9, 10))"""


def _every_run(text: str) -> str:
    return text.replace(RUNS, _EVERY_RUN)


def _number(column: str) -> str:
    return f"CASE WHEN floor({column}) = {column} THEN CAST({column} AS BIGINT)::VARCHAR ELSE {column}::VARCHAR END"


def sql() -> dict[str, str]:
    line = " || '|' || ".join(
        [f"'D:' || {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
        + [f"'D:' || {_number(c)}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [f"'S:' || {c}" for c in ("l_returnflag", "l_linestatus")]
        + ["'S:' || l_shipdate::TIMESTAMP::VARCHAR", "'D:' || (l_shipdate < TIMESTAMP '1997-01-01')::INT"]
    )
    return {
        "load_questions": f"""WITH {QUESTIONS} SELECT question_id, db_id, question, evidence, gold_sql,
  CASE WHEN question_id % 10 = 0 THEN 'unknown' ELSE difficulty END AS difficulty FROM questions""",
        "load_predictions": f"""{RESULTS} SELECT r.tag, r.question_id, p.predicted_sql, p.execution_error, p.gold_error, p.latency_s,
  p.attempts, n.n_rows, n.n_cells::BIGINT AS n_cells, r.category, r.soft_f1
FROM results r JOIN predictions p USING (tag, question_id)
LEFT JOIN (SELECT tag, question_id, count(*) AS n_rows, sum(len(cells)) AS n_cells FROM result_cells GROUP BY ALL) n USING (tag, question_id)""",
        "write_predictions": f"{LOG} SELECT tag, question_id, side, pos, array_to_string(cells, '|') AS row_text FROM result_cells",
        "write_evaluation": f"""{SUMMARY} SELECT summary.*, 'model-a' AS model, CAST(tables AS INTEGER) AS tables_in_prompt, n_results
FROM summary JOIN runs USING (tag) JOIN (SELECT tag, count(*) AS n_results FROM results GROUP BY tag) USING (tag)""",
        "run_summaries": f"""{_every_run(SUMMARY)} SELECT * EXCLUDE (tag), split_part(tag, ' ', 1) AS tag, split_part(tag, ' ', 2) AS generated_at,
  'predictions-' || split_part(tag, ' ', 2) || '.json' AS file FROM summary""",
        "stored_runs": f"""{_every_run(SUMMARY)}, {TOKENS}, levels AS ({_difficulty('tag, difficulty', 'difficulty')}),
level_figures AS (SELECT tag, sum(total)::BIGINT AS n_levels_total, max(soft_f1) AS best_soft_f1 FROM levels GROUP BY tag),
counted AS (
  SELECT tag, count(*) AS n_results, count(*) FILTER (WHERE correct) AS n_correct,
         count(*) FILTER (WHERE category = 'wrong_result') AS wrong_result, count(*) FILTER (WHERE category = 'sql_error') AS sql_error,
         count(*) FILTER (WHERE category = 'gold_failed') AS gold_failed FROM results GROUP BY tag),
newest AS (SELECT split_part(tag, ' ', 1) AS name, max(split_part(tag, ' ', 2)) AS stamp FROM runs GROUP BY 1)
SELECT name AS tag, stamp AS generated_at, 'evaluation-' || stamp || '.json' AS file,
  '| ' || name || ' | model-a | ' || tables || ' | **' || {_decimal_text('execution_accuracy', 4)} || '** | '
  || {_decimal_text('soft_f1', 4)} || ' | ' || prompt_per_question || ' | ' || {_decimal_text('latency_mean_s', 3)} || 's |' AS line,
  wrong_result, sql_error, gold_failed, total AS tokens, n_levels_total, best_soft_f1, n_results, n_correct
FROM newest JOIN runs ON runs.tag = name || ' ' || stamp JOIN summary USING (tag) JOIN tokens USING (tag)
JOIN level_figures USING (tag) JOIN counted USING (tag)""",
        "latest_file": f"WITH {PREDICTIONS} SELECT DISTINCT tag, 'predictions-20240301-120000.json' AS file FROM predictions",
        "load_descriptions": f"WITH {COUNTS}, {_DESCRIPTIONS} SELECT * FROM descriptions",
        "missing_descriptions": f"""WITH {COUNTS}, {_DESCRIPTIONS} SELECT * FROM counts WHERE "table" NOT IN (SELECT "table" FROM descriptions)""",
        "serialize_rows": f"SELECT l_orderkey, {line} AS row_text FROM lineitem",
        "run_query_log": """SELECT 'by_priority' AS query_id, row_number() OVER (ORDER BY p) - 1 AS pos, 'S:' || p || '|D:' || n AS row_text
FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'many_rows', row_number() OVER (ORDER BY o_orderkey DESC) - 1, 'D:' || o_orderkey || '|S:' || o_orderstatus FROM orders
UNION ALL SELECT 'by_nation', row_number() OVER (ORDER BY n_name) - 1, 'S:' || n_name || '|D:' || n
FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1)
UNION ALL SELECT 'with_cte', 0, 'D:' || count(*) || '|D:' || count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 25""",
        "query_log_outcomes": """SELECT query_id, failed, false AS truncated
FROM (VALUES ('by_priority', false), ('many_rows', false), ('by_nation', false), ('with_cte', false),
  ('unknown_column', true), ('write', true), ('runtime', true)) v(query_id, failed)""",
        "row_cap": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
        "gold_once": """SELECT substr(p, 1, 1)::BIGINT AS question_id, row_number() OVER (PARTITION BY p ORDER BY s) - 1 AS pos,
  'S:' || s || '|D:' || n AS row_text FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)""",
        "prediction_log": """WITH asked AS (
  SELECT t.tag, substr(p, 1, 1)::BIGINT AS question_id, shift, pending FROM (
    SELECT o_orderpriority AS p, bool_or(o_orderstatus = 'P') AS pending FROM orders GROUP BY 1),
    (VALUES ('baseline', 0), ('agent', 2)) t(tag, shift))
SELECT tag, question_id, CASE (question_id + shift) % 4 WHEN 0 THEN CASE WHEN pending THEN 'wrong_result' ELSE 'correct' END
  WHEN 1 THEN 'sql_error' ELSE 'correct' END AS category,
  (question_id + shift) % 4 <> 1 AS executed, CAST(question_id * 100 AS INTEGER) AS prompt_tokens FROM asked""",
        **{name: workload.duckdb_sql(name) for name in workload.WORKLOAD},
    }
