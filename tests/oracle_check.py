"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from plumbline.plans.tables import TABLES  # noqa: E402

TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "FLOAT": "float",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value) if not isinstance(value, str) else value


def _bag(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[str, int]:
    """('' or a description of the difference, number of rows)."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    kinds = dict(df.dtypes)
    described = {d[0]: str(d[1]) for d in cursor.description}
    wrong = {n: (kinds[n], t) for n, t in described.items() if TYPES.get(t, t) != kinds[n]}
    a, b = _bag(df.columns, got), _bag(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200_000 else a[:1]
        only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200_000 else b[:1]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}", len(got)
    return (f"types {wrong}" if wrong else ""), len(got)


def main() -> int:
    from plumbline.plans import oracle, registry
    from plumbline.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, sql = registry.queries(), oracle.sql()
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problem, n = compare(spark, con, query, sql[name], sf_dir)
            else:
                problem, n = "", len(query(spark, sf_dir).collect())
                name += " (no sql)"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:<28} rows={n:<8} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
