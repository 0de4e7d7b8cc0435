"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. A query
is timed from building its plan to the end of a full evaluation of its rows.
"""

from __future__ import annotations

import json
import os
import time

from gridtrend.catalogue import QUERIES
from gridtrend.session import local_session

HEADLINE = [
    "fertility_summary",
    "climate_scaled",
    "curated",
    "common_species",
    "group_count_filter",
    "consecutive_runs",
    "dense_index",
    "row_id",
    "mean_se_by_grid",
    "line_fit_by_panel",
    "year_glm_closed_form",
    "year_glm_fitted",
    "posterior_summary",
    "scale_reduction_running",
    "predictive_median",
    "draw_deviance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
