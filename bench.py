"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of warm runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liveops.plans import QUERIES  # noqa: E402
from liveops.session import session  # noqa: E402

HEADLINE = (
    "channel_viewers", "channel_peak", "channel_status", "keyed_latest", "catalog_page",
    "catalog_members", "fleet_rates", "request_route", "message_fanout", "packet_quality",
    "packet_rtt", "packet_gaps", "packet_merge", "packet_mix_rounds", "media_delivered",
    "media_headers_at_join", "playlist_rolling", "playlist_schedule", "series_run_sums",
    "series_kth_largest", "series_drift", "log_rate_limit", "rules_apply", "p2p_directory",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
