"""Wall clock of the headline queries; prints one JSON line.

Every query runs end to end into a complete result: a warm-up on the smallest tables, then
timed runs on $BENCH_SF_DIR. The stage tables that queries start from (mentions, both
graphs) are timed as entries of their own.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threatloom.queries import QUERIES  # noqa: E402
from threatloom.queries import alerts, base, graphs, snapshots, windows  # noqa: E402
from threatloom.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_edges_by_type",
    "e07_extract_entities",
    "e14_normalize_alerts",
    "g08_cooccur_ip",
    "g41_alert_graph_edges_first_seen",
    "a02_edge_counts",
    "a04_canonical_counts",
    "g50_merge_graphs",
    "g52_link_by_ip",
    "g53_link_by_file",
    "g54_link_by_process",
    "g55_link_by_day",
    "g56_link_by_stage",
    "g59_merge_links",
    "w02_snapshot_reports",
    "w03_snapshot_all",
    "w05_snapshots",
    "w09_window_features",
    "f01_local_ids",
    "f02_typed_edges",
    "f07_attend_neighbors",
    "f15_propagate",
    "l01_project_pairs",
    "l02_new_pairs",
    "l03_negative_pairs",
    "l05_sample_edges",
    "l08_roc_auc_total",
    "l10_pr_auc",
]

STAGES = {
    "stage_mentions": base.mention,
    "stage_report_graph": graphs.stored_report_graph,
    "stage_alert_rows": alerts.alert_rows,
    "stage_alert_graph": alerts.stored_alert_graph,
    "stage_merged_graph": snapshots.merged_graph,
    "stage_author_pairs": windows.pairs,
}


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times = {}
    for name, build in STAGES.items():
        build(spark, warm)
        start = time.time()
        build(spark, folder)
        times[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        run = lambda where: QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        run(warm)
        spent = []
        for _ in range(runs):
            start = time.time()
            run(folder)
            spent.append(time.time() - start)
        times[name] = round(statistics.median(spent), 3)
        spark.catalog.clearCache()
    out = {"metric": "total wall clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
