"""SQL equivalents of the profiling and text queries."""

from __future__ import annotations

from plumbline.plans.tables import FOREIGN_KEYS, PRIMARY_KEYS, TABLES

_IN = ", ".join(f"'{t}'" for t in TABLES)

COLUMNS = f"""cols AS (
  SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position AS INTEGER) AS ordinal,
         CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'VARCHAR' THEN 'text'
              WHEN 'DOUBLE' THEN 'double precision' WHEN 'FLOAT' THEN 'real' WHEN 'BOOLEAN' THEN 'boolean'
              WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp without time zone'
              WHEN 'FLOAT[]' THEN 'ARRAY' ELSE data_type END AS data_type,
         is_nullable = 'YES' AS nullable
  FROM information_schema.columns WHERE table_name IN ({_IN}))"""

PKS = "pks AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}')" for t, cs in PRIMARY_KEYS.items() for c in cs
) + ') v("table", "column"))'

FKS = "fks AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{rt}', '{rc}')" for t, cs, rt, rcs in FOREIGN_KEYS for c, rc in zip(cs, rcs)
) + ') v("table", "column", references_table, references_column))'

COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in TABLES) + ")"

# Text, date and boolean columns outside the keys.
_TEXT_COLUMNS = [
    ("benchmark", "text"),
    ("conversations", "role"),
    ("conversations", "text"),
    ("customer", "c_name"),
    ("customer", "c_mktsegment"),
    ("documents", "text"),
    ("documents", "lang"),
    ("documents", "source"),
    ("events", "event_type"),
    ("events", "props"),
    ("lineitem", "l_returnflag"),
    ("lineitem", "l_linestatus"),
    ("nation", "n_name"),
    ("orders", "o_orderstatus"),
    ("orders", "o_orderpriority"),
    ("pages", "url"),
    ("pages", "html"),
    ("part", "p_name"),
    ("part", "p_brand"),
    ("part", "p_type"),
    ("region", "r_name"),
    ("supplier", "s_name"),
]

SAMPLES = (
    "sampled_values AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", \"{c}\" AS v FROM {t} WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\""
        for t, c in _TEXT_COLUMNS
    )
    + """), small AS (SELECT "table", "column" FROM sampled_values GROUP BY ALL HAVING count(*) <= 50),
first_values AS (
  SELECT "table", "column", v, row_number() OVER (PARTITION BY "table", "column" ORDER BY v) AS r
  FROM (SELECT DISTINCT "table", "column", left(v, 40) AS v FROM sampled_values JOIN small USING ("table", "column"))),
samples AS (
  SELECT "table", "column", list(v ORDER BY v) AS sample_values FROM first_values WHERE r <= 3 GROUP BY ALL)"""
)

PROFILE = f"""{COLUMNS}, {PKS}, {FKS}, {COUNTS}, {SAMPLES}, profile AS (
  SELECT "table", "column", ordinal, data_type, nullable, p."column" IS NOT NULL AS is_primary_key,
         coalesce(sample_values, []) AS sample_values
  FROM cols LEFT JOIN pks p USING ("table", "column") LEFT JOIN samples USING ("table", "column"))"""


def quoted(name: str) -> str:
    return f"""CASE WHEN regexp_full_match({name}, '[\\p{{Ll}}\\p{{Lo}}\\p{{N}}_]+') AND regexp_matches({name}, '\\p{{Ll}}')
     THEN {name} ELSE '"' || {name} || '"' END"""


DDL = f"""last_cols AS (SELECT "table", max(ordinal) AS last FROM profile GROUP BY 1),
bodies AS (
  SELECT "table", string_agg(CASE WHEN len(sample_values) = 0 THEN code
      ELSE CASE WHEN length(code) < 48 THEN rpad(code, 48, ' ') ELSE code END || '-- ex: ' || array_to_string(sample_values, ', ') END,
      chr(10) ORDER BY ordinal) AS body
  FROM (SELECT p."table", ordinal, sample_values, '  ' || {quoted('"column"')} || ' ' || data_type
          || CASE WHEN is_primary_key THEN ' PRIMARY KEY' ELSE '' END || CASE WHEN ordinal < last THEN ',' ELSE '' END AS code
        FROM profile p JOIN last_cols l ON p."table" = l."table") GROUP BY "table"),
links AS (
  SELECT "table", string_agg(l, chr(10) ORDER BY l) AS links
  FROM (SELECT "table", '-- ' || {quoted('"table"')} || '.' || {quoted('"column"')} || ' -> '
          || {quoted('references_table')} || '.' || {quoted('references_column')} AS l FROM fks) GROUP BY "table"),
ddl AS (
  SELECT b."table", 'CREATE TABLE ' || {quoted('b."table"')} || ' (' || chr(10) || body || chr(10) || ');'
         || coalesce(chr(10) || links, '') AS ddl
  FROM bodies b LEFT JOIN links l ON b."table" = l."table")"""

SEARCH = """descriptions AS (
  SELECT "table", 'Stores ' || "table" || ' records, ' || n_rows || ' in number.' AS description FROM counts WHERE n_rows > 5),
table_corpus AS (
  SELECT p."table" AS id, p."table" || '. ' || coalesce(any_value(description), '') || ' Columns: '
         || string_agg("column", ' ' ORDER BY ordinal) || '. Values: '
         || coalesce(string_agg(array_to_string(sample_values[1:2], ' '), ' ' ORDER BY ordinal) FILTER (WHERE len(sample_values) > 0), '') AS text
  FROM profile p LEFT JOIN descriptions d ON p."table" = d."table" GROUP BY p."table")"""

QUESTIONS = """table_questions AS (
  SELECT c_custkey AS question_id,
         CASE c_custkey % 3 WHEN 0 THEN 'Total price of the orders placed by customers in segment ' || c_mktsegment
              WHEN 1 THEN 'Which supplier ships parts of size ' || c_nationkey || ' in each lineitem?'
              ELSE 'How many documents with quality labels exist per source and language for nation ' || c_nationkey END AS question,
         CASE WHEN c_custkey % 2 = 0 THEN 'balance above ' || CAST(floor(c_acctbal) AS BIGINT) ELSE '' END AS evidence,
         CASE c_custkey % 3 WHEN 0 THEN ['customer', 'orders'] WHEN 1 THEN ['lineitem', 'part', 'supplier']
              ELSE ['documents', 'labels'] END AS gold
  FROM customer)"""

_IDENTIFIERS = """identifiers AS (
  SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part
  UNION ALL SELECT event_type FROM events UNION ALL SELECT source FROM documents UNION ALL SELECT lang || '_' || source FROM documents)"""

# Keys below are found, not declared: every column of every table is tested.
_ALL_COLUMNS = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


def _unique() -> str:
    parts = [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) > 0 AND count(\"{c}\") = count(*) AND count(DISTINCT \"{c}\") = count(*) AS is_primary_key FROM {t}"
        for t, cs in _ALL_COLUMNS.items()
        for c in cs.split()
    ]
    return " UNION ALL ".join(parts) + " UNION ALL SELECT 'embeddings', 'embedding', false"


def _unique_sets() -> str:
    """Every column and every pair of columns, tried one by one."""
    singles = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique, "
        f"count({c}) = count(*) AS is_full FROM {t}"
        for t, cs in _ALL_COLUMNS.items()
        for c in cs.split()
    )
    pairs = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{a}' AS a, '{b}' AS b, (SELECT count(*) > 0 FROM {t}) "
        f"AND (SELECT count(*) FROM {t}) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) AS is_unique"
        for t, cs in _ALL_COLUMNS.items()
        for i, a in enumerate(cs.split())
        for b in cs.split()[i + 1 :]
    )
    return f"""WITH singles AS ({singles}), pairs AS ({pairs})
SELECT t AS "table", c AS columns, 1 AS n_columns FROM singles WHERE is_unique
UNION ALL
SELECT p.t, p.a || ', ' || p.b, 2 FROM pairs p JOIN singles x ON x.t = p.t AND x.c = p.a JOIN singles y ON y.t = p.t AND y.c = p.b
WHERE p.is_unique AND NOT x.is_unique AND NOT y.is_unique AND x.is_full AND y.is_full"""


_WHOLE = "item_id conv_id turn c_custkey c_nationkey doc_id n_chars vec_id label event_id user_id quality toxic l_orderkey l_partkey l_suppkey l_linenumber n_nationkey n_regionkey o_orderkey o_custkey page_id p_partkey p_size r_regionkey s_suppkey s_nationkey"
_REAL = "c_acctbal value l_quantity l_extendedprice l_discount l_tax o_totalprice p_retailprice s_acctbal"
_TIME = "ts l_shipdate o_orderdate"


def _included(least: float) -> str:
    def kind(c: str) -> str:
        return "whole" if c in _WHOLE.split() else "real" if c in _REAL.split() else "time" if c in _TIME.split() else "text"

    held = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{kind(c)}' AS kind, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, cs in _ALL_COLUMNS.items()
        for c in cs.split()
    )
    return f"""WITH held AS ({held}), sizes AS (SELECT t, c, count(*) AS n FROM held GROUP BY ALL),
shared AS (
  SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS n_shared FROM held a JOIN held b USING (kind, v)
  WHERE a.t <> b.t OR a.c <> b.c GROUP BY ALL)
SELECT t AS "table", c AS "column", rt AS references_table, rc AS references_column, n AS n_values, n_shared,
  round(n_shared / n::DOUBLE, 6) AS coverage
FROM shared JOIN sizes USING (t, c) WHERE n_shared >= {least} * n"""


def _nulls() -> str:
    parts = [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) - count(\"{c}\") AS n_nulls FROM {t}"
        for t, cs in _ALL_COLUMNS.items()
        for c in cs.split() + (["embedding"] if t == "embeddings" else [])
    ]
    return " UNION ALL ".join(parts)


def _inclusion(candidates: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS columns, '{rt}' AS references_table, count({c}) AS n_rows,
  count({c}) FILTER (WHERE {c} NOT IN (SELECT {rc} FROM {rt})) AS orphans,
  round(1 - count({c}) FILTER (WHERE {c} NOT IN (SELECT {rc} FROM {rt})) / count({c})::DOUBLE, 6) AS coverage FROM {t}"""
        for t, c, rt, rc in candidates
    )


FK_CANDIDATES = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]

_FENCE = "chr(96) || chr(96) || chr(96)"


def sql() -> dict[str, str]:
    completion = f"""CASE o_orderkey % 5 WHEN 0 THEN gold_sql WHEN 1 THEN {_FENCE} || 'sql' || chr(10) || gold_sql || ';' || chr(10) || {_FENCE}
   WHEN 2 THEN 'Here it is:' || chr(10) || {_FENCE} || 'SQL ' || gold_sql || ' ;; ' || {_FENCE} || ' done'
   WHEN 3 THEN '  ' || gold_sql || ';;' || chr(10) ELSE {_FENCE} || chr(10) || 'SELECT 1' || chr(10) || {_FENCE} || ' or ' || {_FENCE} || 'sql SELECT 2' || {_FENCE} END"""
    return {
        "profile_columns": f"""WITH {COLUMNS}, nulls AS ({_nulls()})
SELECT "table", "column", ordinal, data_type, nullable, n_nulls FROM cols JOIN nulls USING ("table", "column")""",
        "row_counts": f"WITH {COUNTS} SELECT * FROM counts",
        "sample_values": f"""WITH {SAMPLES} SELECT "table", "column", array_to_string(sample_values, '|') AS sample_values FROM samples""",
        "primary_keys": _unique(),
        "composite_keys": _unique_sets(),
        "inclusions": _included(1.0),
        "partial_inclusions": _included(0.8),
        "foreign_keys": f'WITH {FKS}, {COUNTS} SELECT fks.*, n_rows FROM fks JOIN counts USING ("table")',
        "fk_discovery": _inclusion(FK_CANDIDATES),
        "catalog_profile": f"""WITH {PROFILE} SELECT "table", "column", ordinal, data_type, nullable, is_primary_key,
  array_to_string(sample_values, '|') AS sample_values, n_rows,
  f.references_table, f.references_column
FROM profile JOIN counts USING ("table") LEFT JOIN fks f USING ("table", "column")""",
        "catalog_summary": f"""WITH {PROFILE} SELECT
  (SELECT count(*) FROM counts) AS n_tables, (SELECT count(*) FROM profile) AS n_columns,
  (SELECT count(*) FROM fks) AS n_foreign_keys,
  (SELECT count(*) FROM profile WHERE len(sample_values) > 0) AS n_sampled_columns,
  (SELECT count(*) FROM counts WHERE "table" NOT IN (SELECT "table" FROM pks)) AS n_without_primary_key,
  (SELECT count(*) FROM counts WHERE "table" NOT IN (SELECT "table" FROM fks)) AS n_without_foreign_key""",
        "largest_tables": f'WITH {COUNTS} SELECT * FROM counts ORDER BY n_rows DESC, "table" LIMIT 10',
        "table_detail": f"""WITH {PROFILE} SELECT "table", ordinal,
  '  ' || CASE WHEN length("column") < 22 THEN rpad("column", 22, ' ') ELSE "column" END || ' ' || data_type
  || CASE WHEN is_primary_key AND NOT nullable THEN '  [PK, NOT NULL]' WHEN is_primary_key THEN '  [PK]' WHEN NOT nullable THEN '  [NOT NULL]' ELSE '' END
  || CASE WHEN len(sample_values) > 0 THEN '   ex: ' || array_to_string(sample_values, ', ') ELSE '' END AS line FROM profile
UNION ALL SELECT "table", 1000000, '  FK: ' || "column" || ' -> ' || references_table || '.' || references_column FROM fks""",
        "quote_identifier": f"WITH {_IDENTIFIERS} SELECT name, {quoted('name')} AS quoted, count(*) AS n FROM identifiers GROUP BY ALL",
        "estimate_tokens": "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS est_tokens FROM documents",
        "extract_sql": rf"""WITH texts AS (
  SELECT o_orderkey, {completion} AS completion FROM (SELECT o_orderkey, 'SELECT * FROM lineitem WHERE l_orderkey = ' || o_orderkey AS gold_sql FROM orders)),
bodies AS (SELECT o_orderkey, CASE WHEN regexp_matches(completion, '(?is)```(?:sql)?\s*(.*?)```')
  THEN regexp_extract(completion, '(?is)```(?:sql)?\s*(.*?)```', 1) ELSE completion END AS body FROM texts)
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', ''), ';+$', ''), '^\s+', ''), '\s+$', '') AS sql_text FROM bodies""",
        "render_table": f'WITH {PROFILE}, {DDL} SELECT * FROM ddl',
        "full_schema": f"""WITH {PROFILE}, {DDL} SELECT string_agg(ddl, chr(10) || chr(10) ORDER BY "table") AS schema_text FROM ddl""",
        "searchable_text": f"WITH {PROFILE}, {SEARCH} SELECT * FROM table_corpus",
        "describe_context": f"""WITH {PROFILE}, {DDL}, linked AS (
  SELECT "table", string_agg(references_table, ', ' ORDER BY "column") AS linked FROM fks GROUP BY 1)
SELECT d."table", ddl || chr(10) || chr(10) || 'Lignes estimées : ' || format('{{:,}}', n_rows) || chr(10)
  || 'Tables liées : ' || coalesce(linked, 'aucune') AS text
FROM ddl d JOIN counts c ON d."table" = c."table" LEFT JOIN linked l ON d."table" = l."table" """,
    }
