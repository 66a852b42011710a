"""Wall time of the headline queries: one JSON line, warm, median of three runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from headway.catalog import QUERIES
from headway.session import local_session

HEADLINE = (
    "w01_latest_per", "w04_lag_n", "w05_range_trend", "w06_rows_mean", "w13_interpolate", "j07_point_in_polygon",
    "j08_interval_join", "j14_latest_batch", "j19_chain", "a06_alert_features", "a11_route_summary", "a24_stop_type_agg",
    "a32_percentiles", "a27_regression_metrics", "qs1_route_windows", "qs5_past_trips", "t02_split_groups",
    "v02_active_service_dates", "v03_base_updates", "v04_base_positions", "v05_analytics", "v08_route_training",
    "v13_stop_board", "v14_route_timetable", "c15_trip_history", "m08_score_regions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    times = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
