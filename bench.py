"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores. Every query
runs once to warm up on the smallest scale, then once timed, written to a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mirrorframe.plans.registry import QUERIES  # noqa: E402
from mirrorframe.session import local_session  # noqa: E402

HEADLINE = [
    "wins_per_synthesizer", "summary_pivot", "plot_data", "legacy_summary", "uniform_sample", "bootstrap_rows",
    "label_sample", "mixed_encode", "gaussian_copula_sample", "ks_complement", "tv_complement",
    "correlation_similarity", "contingency_similarity", "quality_report", "diagnostic_report", "new_row_synthesis",
    "referential_integrity", "cardinality_shape", "mutual_information", "sequence_features", "referential_subset",
    "dataset_summary",
]
WARM_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        if Path(WARM_DIR).exists():
            QUERIES[name](spark, WARM_DIR).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
