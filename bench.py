"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from postlake.queries import QUERIES
from postlake.session import build_session

HEADLINES = [
    "zip_lookup_batch",
    "address_autofill",
    "search_exact",
    "search_prefix",
    "search_partial",
    "search_concat",
    "paren_strip",
    "width_normalise",
    "split_row_merge",
    "feed_files_clean",
    "upsert_large",
    "version_diff",
    "publish_current",
    "quality_counts",
    "export_manifest",
    "log_lines",
    "sli_5min",
    "alert_level",
    "slo_report",
    "network_match",
    "access_audit",
    "stream_sli",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["prefectures"](spark, sf_dir).collect()  # start the engine
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
