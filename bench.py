"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per query), "sf"}. Each query is executed fully with the ``noop``
sink (every row produced, nothing collected). The typed cohort is derived and
written once first (``cohort_materialize``), as every analysis query reads it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "wide_ingest", "cause_ratio", "cause_period_summary", "admissions_by_presence",
    "paired_event_counts", "period_wide", "paired_diff_t", "mcnemar", "cohen_d_paired",
    "unpaired_event_flags", "summary_continuous", "summary_categorical", "stratified_summary",
    "summary_documents", "rank_sum", "kruskal_wallis", "chi_square", "fisher_2x2",
    "summary_with_tests", "logit_risk", "nb_count_model", "csv_ingest", "demographics_table",
    "overall_table", "admission_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cohortflow import build_session
    from cohortflow.plans import queries as Q

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.ui.showConsoleProgress": "false"})
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    Q.wide(spark, sf_dir)
    times["cohort_materialize"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
