"""SQL equivalents of the audit queries."""

from __future__ import annotations

from plumbline.plans.oracle_catalog import COLUMNS
from plumbline.plans.oracle_eval import CELLS, MATCHES, PREDICTIONS, half_even
from plumbline.plans.query_refs import CASES


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


_SHAPES = ", ".join(
    "(" + ", ".join(_value(v) for v in (case, seq, *ref)) + ")" for case, refs in CASES.items() for seq, ref in enumerate(refs)
)

REFS = f"""audited(tag, shift) AS (VALUES ('baseline', 0), ('agent', 2)),
shapes("case", seq, kind, name, qualifier, alias, scope_kind) AS (VALUES {_SHAPES}),
refs AS (
  SELECT tag || ':' || o_orderkey AS query_id, s.seq, s.kind, s.name, s.qualifier, s.alias, s.scope_kind
  FROM orders, audited JOIN shapes s ON s."case" = (o_orderkey + shift) % {len(CASES)}),
{COLUMNS}, catalog AS (SELECT DISTINCT lower("table") AS t, lower("column") AS c FROM cols),
tables AS (SELECT DISTINCT t FROM catalog),
closest AS (
  SELECT n.name, min(t) AS suggestion FROM (SELECT DISTINCT name FROM refs WHERE kind = 'table') n
  JOIN tables ON contains(t, lower(n.name)) OR contains(lower(n.name), t) GROUP BY 1),
owners AS (
  SELECT c, 'elle existe dans ' || array_to_string(list_sort(list(t))[1:3], ', ') AS suggestion FROM catalog GROUP BY c),
aliases AS (
  SELECT query_id, k AS "key", arg_max(name, seq * 2 + nth) AS "table" FROM (
    SELECT query_id, seq, 0 AS nth, lower(alias) AS k, name FROM refs WHERE kind = 'table' AND alias IS NOT NULL
    UNION ALL SELECT query_id, seq, 1, lower(name), name FROM refs WHERE kind = 'table') GROUP BY 1, 2)"""


def _found(strict: bool) -> str:
    table_scope = "" if strict else "AND scope_kind <> 'cte'"
    column_scope = "" if strict else "AND scope_kind <> 'alias'"
    return f"""table_issues AS (
  SELECT query_id, CAST(5 AS INTEGER) AS level, seq::BIGINT AS seq, 'unknown_table' AS kind, name AS target,
         'la table ' || name || ' n''existe pas' AS message, suggestion
  FROM refs LEFT JOIN closest USING (name) WHERE kind = 'table' AND lower(name) NOT IN (SELECT t FROM tables) {table_scope}),
qualified_issues AS (
  SELECT r.query_id, CAST(5 AS INTEGER) AS level, seq::BIGINT AS seq, 'unknown_column' AS kind, qualifier || '.' || name AS target,
         'la colonne ' || name || ' n''appartient pas à ' || a."table" AS message, suggestion
  FROM refs r JOIN aliases a ON a.query_id = r.query_id AND a."key" = lower(qualifier) LEFT JOIN owners o ON o.c = lower(name)
  WHERE kind = 'column' AND name <> '*' {column_scope} AND lower(a."table") IN (SELECT t FROM tables)
    AND NOT EXISTS (SELECT 1 FROM catalog k WHERE k.t = lower(a."table") AND k.c = lower(name))),
scope_issues AS (
  SELECT query_id, CAST(5 AS INTEGER) AS level, seq::BIGINT AS seq, 'unknown_column' AS kind, name AS target,
         'la colonne ' || name || ' n''appartient à aucune table de la requête' AS message, suggestion
  FROM refs r LEFT JOIN owners o ON o.c = lower(name)
  WHERE kind = 'column' AND qualifier IS NULL AND name <> '*' {column_scope}
    AND NOT EXISTS (SELECT 1 FROM refs x JOIN catalog k ON k.t = lower(x.name) WHERE x.kind = 'table' AND x.query_id = r.query_id AND k.c = lower(r.name)))"""


POLICY = """roots AS (SELECT query_id, count(*) AS n, min(seq) AS seq, arg_min(name, seq) AS name FROM refs WHERE kind = 'statement' GROUP BY 1),
policy AS (
  SELECT query_id, 0 AS level, seq::BIGINT AS seq, 'empty' AS kind, '' AS target, 'requête vide' AS message FROM refs WHERE kind = 'empty'
  UNION ALL SELECT query_id, 1, seq, 'parse', '', 'SQL non parsable : ' || name FROM refs WHERE kind = 'parse_error'
  UNION ALL SELECT query_id, 2, seq, 'multiple', '', n || ' instructions, une seule attendue' FROM roots WHERE n > 1
  UNION ALL SELECT query_id, 3, seq, 'not_select', name, 'seul SELECT est autorisé, reçu ' || name FROM roots
            WHERE n = 1 AND name NOT IN ('Select', 'Union', 'Subquery')
  UNION ALL SELECT query_id, 4, seq, 'forbidden', upper(name), 'opération interdite : ' || upper(name) FROM refs WHERE kind = 'operation')"""


def _verdicts(strict: bool) -> str:
    return f"""{REFS}, {_found(strict)}, {POLICY}, issues AS (
  SELECT *, NULL::VARCHAR AS suggestion FROM policy UNION ALL SELECT * FROM table_issues
  UNION ALL SELECT * FROM qualified_issues UNION ALL SELECT * FROM scope_issues),
firsts AS (SELECT * FROM issues QUALIFY level = min(level) OVER (PARTITION BY query_id)),
verdicts AS (
  SELECT q.query_id, n_issues IS NULL AS ok, coalesce(blocked, false) AS blocked, CAST(coalesce(n_issues, 0) AS INTEGER) AS n_issues,
         lines[1] AS first_issue, coalesce(array_to_string(list_transform(lines, lambda x: '- ' || x), chr(10)), '') AS feedback
  FROM (SELECT DISTINCT query_id FROM refs) q LEFT JOIN (
    SELECT query_id, count(*) AS n_issues, bool_or(kind IN ('forbidden', 'not_select')) AS blocked,
           list(message || CASE WHEN suggestion IS NOT NULL THEN ' (peut-être : ' || suggestion || ')' ELSE '' END
                ORDER BY kind <> 'unknown_table', seq) AS lines
    FROM firsts GROUP BY 1) USING (query_id))"""


BUCKETS = f"""{PREDICTIONS}, {CELLS}, {MATCHES}, {_verdicts(False)}, bucketed AS (
  SELECT tag, question_id, execution_error, first_issue,
         CASE WHEN execution_error IS NOT NULL AND NOT ok THEN 'caught' WHEN execution_error IS NOT NULL THEN 'missed'
              WHEN correct AND NOT ok THEN 'false_positive' ELSE 'clean' END AS bucket
  FROM predictions p JOIN verdicts v ON v.query_id = tag || ':' || question_id JOIN matches USING (tag, question_id))"""


def sql() -> dict[str, str]:
    issue = "query_id, level, seq, kind, target, message, suggestion"
    found = _found(False)
    return {
        "catalog_index": f"""WITH {REFS} SELECT t AS "table", c AS "column", count(r.name) AS n_refs
FROM catalog LEFT JOIN (SELECT name FROM refs WHERE kind = 'column') r ON lower(r.name) = c GROUP BY t, c""",
        "unknown_tables": f"WITH {REFS}, {found} SELECT {issue} FROM table_issues",
        "closest_table": f"""WITH {REFS} SELECT name, count(*) AS n_refs, any_value(suggestion) AS suggestion
FROM refs LEFT JOIN closest USING (name) WHERE kind = 'table' GROUP BY name""",
        "column_owners": f"""WITH {REFS} SELECT lower(name) AS "column", count(*) AS n_refs, any_value(suggestion) AS suggestion
FROM refs LEFT JOIN owners ON c = lower(name) WHERE kind = 'column' GROUP BY 1""",
        "alias_map": f"WITH {REFS} SELECT * FROM aliases",
        "unknown_qualified_columns": f"WITH {REFS}, {found} SELECT {issue} FROM qualified_issues",
        "out_of_scope_columns": f"WITH {REFS}, {found} SELECT {issue} FROM scope_issues",
        "policy_flags": f"WITH {REFS}, {POLICY} SELECT *, NULL::VARCHAR AS suggestion FROM policy",
        "audit_findings": f"""WITH {REFS}, {found}, {POLICY}
SELECT {issue} FROM (SELECT *, NULL::VARCHAR AS suggestion FROM policy) UNION ALL SELECT {issue} FROM table_issues
UNION ALL SELECT {issue} FROM qualified_issues UNION ALL SELECT {issue} FROM scope_issues""",
        "audit_verdict": f"WITH {_verdicts(False)} SELECT * FROM verdicts",
        "audit_verdict_strict": f"WITH {_verdicts(True)} SELECT * FROM verdicts",
        "audit_confusion": f"""WITH {BUCKETS} SELECT tag, count(*) AS questions,
  count(*) FILTER (WHERE bucket IN ('caught', 'missed')) AS sql_errors,
  count(*) FILTER (WHERE bucket = 'caught') AS caught, count(*) FILTER (WHERE bucket = 'missed') AS missed,
  CASE WHEN count(*) FILTER (WHERE bucket IN ('caught', 'missed')) > 0 THEN
    {half_even("count(*) FILTER (WHERE bucket = 'caught') / (count(*) FILTER (WHERE bucket IN ('caught', 'missed')))::DOUBLE", 3)} ELSE 0.0 END AS detection_rate,
  count(*) FILTER (WHERE bucket = 'false_positive') AS false_positives, count(*) FILTER (WHERE bucket = 'clean') AS clean
FROM bucketed GROUP BY tag""",
        "audit_examples": f"""WITH {BUCKETS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY question_id) AS nth FROM bucketed WHERE bucket <> 'clean'),
later AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY question_id) AS nth2 FROM ranked WHERE nth > 5 AND bucket <> 'caught'),
taken AS (
  SELECT tag, question_id, execution_error, first_issue, bucket FROM ranked WHERE nth <= 5
  UNION ALL SELECT tag, question_id, execution_error, first_issue, bucket FROM later WHERE bucket = 'false_positive' OR nth2 <= 3)
SELECT tag, question_id, bucket, question_id || CASE bucket WHEN 'caught' THEN ' détectée : ' || first_issue
  WHEN 'missed' THEN ' manquée : ' || left(execution_error, 90) ELSE ' FAUX POSITIF : ' || first_issue END AS line FROM taken""",
    }
