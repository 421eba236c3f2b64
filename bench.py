"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names, or 'all' (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import registry  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = [
    "w_join_group",
    "execution_match",
    "evaluate_questions",
    "by_difficulty",
    "attempt_rollup",
    "running_failures",
    "stratified_sample",
    "sample_values",
    "primary_keys",
    "render_table",
    "text_vectors",
    "dense_topk",
    "lexical_topk",
    "hybrid_topk",
    "expand_fk",
    "build_prompt",
    "audit_verdict",
    "audit_confusion",
    "load_predictions",
    "run_query_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = registry.queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    # One small run first, so that start-up is not counted with the first query.
    queries["w_join_group"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:<28} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
