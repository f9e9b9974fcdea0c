"""Times the registered queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS, BENCH_RUNS (timed runs per query, the
median counts), BENCH_QUERIES (comma list or `all`; default: the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from ledgerloom.catalog import QUERIES, runner
from ledgerloom.session import local_session

HEADLINE = [
    "num_lenient", "code_text", "normalize_text", "row_key_match", "file_meta", "scan_indicator", "scan_cells",
    "totals_check", "no_data_check", "verify_readback", "upsert_series", "merge_dups", "last_wins", "series_wide", "series_unpivot",
    "issues_all", "row_alloc", "backfill_values", "parent_rollup", "corrected_copy", "rule_checks", "subtotal_check", "page_summary",
    "merge_fill", "col_paths", "wide_summary", "long_extract", "region_cells", "append_new", "append_stats", "dedup_first",
    "ignore_filter", "assign_cells", "near_scores", "cluster_1d", "text_lines", "merge_fragments", "photo_lines", "items_to_grid",
    "overlap_frag", "align_exact", "align_fuzzy", "tpl_score", "table_diff", "grid_accuracy", "export_json", "unique_names", "stream_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    runner(QUERIES["totals_check"])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            runner(QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
