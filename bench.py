"""Headline timings; prints one JSON line.

    BENCH_SF_DIR  table directory (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

Every query runs whole and is drained into the no-op sink, so result transfer
to Python is not part of the time. Planning is. A query's time is the median of
three runs; one that takes over ``SLOW`` seconds runs once.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from trailmill.plans.catalogue import all_queries
from trailmill.session import build_session

HEADLINE = (
    "overview_kpis", "overview_fused", "overview_activities_by_month",
    "overview_distance_by_month_type", "overview_elevation_by_month_type",
    "overview_time_by_month_type", "gear_activities", "gear_distance_by_month",
    "gear_avg_speed_by_month", "gear_box_distance", "gear_box_effort", "gear_summary",
    "weather_temp_rhum", "weather_temp_distance", "weather_join", "weather_join_grid",
    "perf_avg_speed_by_month_type", "perf_box_avg_speed", "perf_points_avg_speed",
    "timing_month_distance", "timing_weekday_time", "timing_hour_activities",
    "select_year_brands", "activity_detail", "activities_enriched", "gear_join_spread",
    "landing_pages", "records_round_trip", "domain_brands", "status_latest",
    "table_refresh_reload", "refresh_pipeline", "weather_join_shuffled",
)
SLOW = 6.0


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    for key in ("gear_distance", "gear_box_elevation", "weather_rhum_distance"):
        drain(queries[key](spark, sf_dir))  # warm the JVM, not the queries below
    seconds = {}
    for key in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and (not runs or runs[0] <= SLOW):
            started = time.perf_counter()
            drain(queries[key](spark, sf_dir))
            runs.append(time.perf_counter() - started)
        seconds[key] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
