"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_SMALLER  a second, smaller folder whose times show the growth (default: sf0.01
                   beside the first, if it is there)
"""

from __future__ import annotations

import json
import os
import sys
import time

from stoopwise.catalog import all_queries
from stoopwise.session import local_session

HEADLINES = (
    "walk_stops",
    "walk_stops_15_min",
    "stops_all",
    "walk_groceries",
    "walk_stops_geojson",
    "transit_rollups",
    "violation_status",
    "report_text",
    "code_catalogue",
    "violations_unique",
    "addresses_to_summarise",
    "grocery_sync",
    "transit_route_stops",
    "saved_state",
    "saved_cards",
    "property_intake",
    "route_map",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session("bench", cpus=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    # Start the workers before anything is timed.
    spark.range(0, 1_000_000, 1, cpus).selectExpr("sum(id)").collect()

    def timed(where: str) -> dict[str, float]:
        times = {}
        for name in names:
            start = time.perf_counter()
            # Every row and column is computed, nothing is kept.
            known[name].run(spark, where).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        return times

    times = timed(folder)
    total = round(sum(times.values()), 3)
    smaller = os.environ.get("BENCH_SMALLER", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01"))
    second = {}
    if os.path.isdir(smaller) and os.path.realpath(smaller) != os.path.realpath(folder):
        second = {"smaller": os.path.basename(smaller.rstrip("/")), "smaller_queries": timed(smaller)}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                **second,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
