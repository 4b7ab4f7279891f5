"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs
twice; the second (warm) time counts, the first is reported beside it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from mutspan.plans import catalog
from mutspan.session import build_session

HEADLINE = [
    "A7_operator_rates",
    "A10_A13_A14_summary",
    "W2_display_round",
    "W8_episodes",
    "A12_status_patterns",
    "J18_match_reports",
    "A1_A2_kill_details",
    "A17_method_summary",
    "A19_mutant_verdicts",
    "A21_suite_scores",
    "A23_test_set_scores",
    "A25_mapped_run_counts",
    "J28_mapped_candidates",
    "G4_exact_sample",
    "J5_method_calls",
    "J10_propagation_candidates",
    "J13_resolve_callees",
    "M1_merged_imports",
    "W12_entry_candidates",
    "J29_W10_witness_chains",
    "J30_prior_states",
    "J31_A28_shared_experience",
    "A26_action_statistics",
    "A27_linear_statistics",
    "G7_chosen_actions",
    "F43_root_causes",
    "W23_budgeted_sections",
    "T2_streamed_mutant_state",
]


def timed(spark, name: str, sf_dir: str) -> tuple[float, int]:
    start = time.perf_counter()
    rows = catalog.QUERIES[name](spark, sf_dir)
    # count a row hash so that no output column can be pruned away
    count = rows.selectExpr("count(*) AS n", "bit_xor(xxhash64(*)) AS h").collect()[0]["n"]
    return time.perf_counter() - start, count


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    if len(sys.argv) > 1:
        names = [n for n in catalog.QUERIES if any(n.startswith(p) for p in sys.argv[1:])] if sys.argv[1] != "all" else list(catalog.QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold, rows = {}, {}, {}
    for name in names:
        first, _ = timed(spark, name, sf_dir)
        second, count = timed(spark, name, sf_dir)
        cold[name], warm[name], rows[name] = round(first, 3), round(second, 3), count
        print(name, cold[name], warm[name], count, file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "warm seconds over headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "rows": rows,
                "sf": float(found.group(1)) if found else sf_dir,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
